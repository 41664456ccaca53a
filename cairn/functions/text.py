"""Enrichment and identifier functions as Spark column expressions.

Every function takes and returns ``Column`` so that the work stays inside
whole-stage codegen; nothing here runs Python per row.

Regex dialect: the semantics are those of Python's Unicode-aware ``re``. Java
regex differs in what ``\\w``, ``\\b`` and ``\\s`` mean, so the patterns below
spell the classes out explicitly:

* word character  = ``[\\p{L}\\p{N}_]`` (letters, numbers, underscore)
* word boundary   = negative look-behind / look-ahead on that class
* whitespace      = the characters Python's ``str.isspace`` accepts
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn import schema as S

# Characters for which Python's str.isspace() is true.
WS_CHARS = (r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS = f"[{WS_CHARS}]"
WORD = r"[\p{L}\p{N}_]"
_LB = f"(?<!{WORD})"
_RB = f"(?!{WORD})"

# A cheap first-character lookahead lets the engine reject most positions
# before the look-behind and the body are tried.
CAMEL_RE = "(?=[A-Z])" + _LB + r"[A-Z][a-z]+(?:[A-Z][a-z]+)+" + _RB
ACRONYM_RE = "(?=[A-Z])" + _LB + r"[A-Z]{2,}" + _RB
# Whole word tokens that start with an ASCII capital: CamelCase words,
# acronyms and dictionary words (all made of word characters) are exactly
# such tokens, so one pass finds the candidates for all three.
CAP_TOKEN_RE = "(?=[A-Z])" + _LB + r"[A-Z][\p{L}\p{N}_]*"
CAMEL_FULL = r"\A[A-Z][a-z]+(?:[A-Z][a-z]+)+\z"
ACRONYM_FULL = r"\A[A-Z]{2,}\z"
_TECH_WORDS = [w for grp in S.TECH_TERMS for w in grp]
_TECH_PLAIN = [w for w in _TECH_WORDS if re.fullmatch(r"\w+", w)]
_TECH_OTHER = [w for w in _TECH_WORDS if w not in _TECH_PLAIN]
TECH_OTHER_RE = _LB + "(?:" + "|".join(re.escape(w) for w in _TECH_OTHER) + ")" + _RB
# Mentions and hashtags share one pass: the whole match is the entity.
TAG_RE = r"[@#][\p{L}\p{N}_]+"
MENTION_RE = r"@[\p{L}\p{N}_]+"
HASHTAG_RE = r"#[\p{L}\p{N}_]+"
DQUOTE_RE = r'"([^"]{2,30})"'
SQUOTE_RE = r"'([^']{2,30})'"
TECH_RE = ("(?=[" + "".join(sorted({w[0] for w in _TECH_WORDS})) + "])" + _LB + "(?:"
           + "|".join(re.escape(w) for w in _TECH_WORDS) + ")" + _RB)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(_c(c), f"\\A{WS}+|{WS}+\\z", "")


def words(c) -> Column:
    """Python ``str.split()``: runs of whitespace separate words; no empty words."""
    return F.filter(F.split(_c(c), f"{WS}+"), lambda w: w != "")


NON_WS = f"[^{WS_CHARS}]"


def leading_words_text(c, n: int) -> Column:
    """The text spanning the first ``n`` words (inner whitespace kept).

    One anchored, bounded regex: only the prefix of the text is scanned, so
    the cost does not grow with the length of the whole text."""
    pat = f"\\A{WS}*({NON_WS}+(?:{WS}+{NON_WS}+){{0,{n - 1}}})"
    return F.regexp_extract(_c(c), pat, 1)


def first_words(c, n: int) -> Column:
    """The first ``n`` words joined by one blank (``' '.join(t.split()[:n])``)."""
    return F.regexp_replace(leading_words_text(c, n), f"{WS}+", " ")


# --------------------------------------------------------------------- E1

def summary(title, content, max_words: int = S.SUMMARY_MAX_WORDS,
            min_words: int = S.SUMMARY_MIN_WORDS, max_chars: int = S.SUMMARY_MAX_CHARS) -> Column:
    """Text before the first '.', stripped. Over ``max_words`` words: the first
    ``max_words`` joined by one blank plus '...'; otherwise the stripped text
    with its inner spacing. Under ``min_words`` words: prefixed 'title: '.
    Cut at ``max_chars`` characters."""
    return summary_of_first(title, first_sentence(content), max_words, min_words, max_chars)


def first_sentence(content) -> Column:
    """Text before the first '.', stripped (E1's input)."""
    return strip_ws(F.split_part(_c(content), F.lit("."), F.lit(1)))


def summary_of_first(title, first, max_words: int = S.SUMMARY_MAX_WORDS,
                     min_words: int = S.SUMMARY_MIN_WORDS, max_chars: int = S.SUMMARY_MAX_CHARS) -> Column:
    """E1 from a precomputed ``first_sentence`` column."""
    first = _c(first)
    # Only the first max_words + 1 words are ever looked at.
    w = words(leading_words_text(first, max_words + 1))
    n = F.size(w)
    body = F.when(n <= max_words, first).otherwise(
        F.concat(F.array_join(F.slice(w, 1, max_words), " "), F.lit("...")))
    body = F.when(F.least(n, F.lit(max_words)) < min_words,
                  F.concat(_c(title), F.lit(": "), body)).otherwise(body)
    return F.substring(body, 1, max_chars)


# ------------------------------------------------------------------ E2-E9

def camel_case(text) -> Column:
    """CamelCase words with at least two lower-case-tailed humps."""
    return F.regexp_extract_all(_c(text), F.lit(CAMEL_RE), 0)


def acronyms(text) -> Column:
    """Whole-word runs of 2+ capitals, minus the stop words."""
    stop = F.array(*[F.lit(w) for w in S.ACRONYM_STOPWORDS])
    return F.array_except(F.regexp_extract_all(_c(text), F.lit(ACRONYM_RE), 0), stop)


def mentions(text) -> Column:
    """E4: '@' followed by word characters, kept with '@'."""
    return F.regexp_extract_all(_c(text), F.lit(MENTION_RE), 0)


def hashtags(text) -> Column:
    """E5: '#' followed by word characters, kept with '#'."""
    return F.regexp_extract_all(_c(text), F.lit(HASHTAG_RE), 0)


def double_quoted(text) -> Column:
    """Inner text of "..." spans of 2-30 characters."""
    return F.regexp_extract_all(_c(text), F.lit(DQUOTE_RE), 1)


def single_quoted(text) -> Column:
    """Inner text of '...' spans of 2-30 characters (apostrophes pair up)."""
    return F.regexp_extract_all(_c(text), F.lit(SQUOTE_RE), 1)


def tech_terms(text) -> Column:
    """Dictionary words, whole words, case-sensitive (one alternation)."""
    return F.regexp_extract_all(_c(text), F.lit(TECH_RE), 0)


def entities_of(text) -> Column:
    """E9 over one text: union of E2-E8, distinct, sorted by code point.

    Same result as running E2-E8 separately, in fewer passes over the text:
    one pass collects capitalised word tokens (filtered into CamelCase,
    acronyms and plain dictionary words), one collects mentions and
    hashtags, one each the two quote forms, one the dictionary words that
    contain a non-word character."""
    t = _c(text)
    tok = F.regexp_extract_all(t, F.lit(CAP_TOKEN_RE), 0)
    stop = F.array(*[F.lit(w) for w in S.ACRONYM_STOPWORDS])
    parts = F.concat(
        F.filter(tok, lambda x: x.rlike(CAMEL_FULL)),
        F.array_except(F.filter(tok, lambda x: x.rlike(ACRONYM_FULL)), stop),
        F.array_intersect(tok, F.array(*[F.lit(w) for w in _TECH_PLAIN])),
        F.regexp_extract_all(t, F.lit(TECH_OTHER_RE), 0),
        F.regexp_extract_all(t, F.lit(TAG_RE), 0),
        double_quoted(t),
        single_quoted(t),
    )
    return F.array_sort(F.array_distinct(parts))


def with_entities(df, text, out: str = "entities"):
    """E9 as a staged transform: the token pass is its own column, so the
    three token filters do not each re-run the regex over the whole text."""
    t = _c(text)
    df = df.withColumn("_e_tok", F.regexp_extract_all(t, F.lit(CAP_TOKEN_RE), 0))
    tok = F.col("_e_tok")
    stop = F.array(*[F.lit(w) for w in S.ACRONYM_STOPWORDS])
    parts = F.concat(
        F.filter(tok, lambda x: x.rlike(CAMEL_FULL)),
        F.array_except(F.filter(tok, lambda x: x.rlike(ACRONYM_FULL)), stop),
        F.array_intersect(tok, F.array(*[F.lit(w) for w in _TECH_PLAIN])),
        F.regexp_extract_all(t, F.lit(TECH_OTHER_RE), 0),
        F.regexp_extract_all(t, F.lit(TAG_RE), 0),
        double_quoted(t),
        single_quoted(t),
    )
    return df.withColumn(out, F.array_sort(F.array_distinct(parts))).drop("_e_tok")


def with_summary(df, title, content, out: str = "summary"):
    """E1 as a staged transform (the first sentence is its own column)."""
    df = df.withColumn("_s_first", first_sentence(content))
    return df.withColumn(out, summary_of_first(title, "_s_first")).drop("_s_first")


def entities(title, content) -> Column:
    """Entities of ``title + ' ' + content``."""
    return entities_of(F.concat(_c(title), F.lit(" "), _c(content)))


# ----------------------------------------------------------------- E10-E13

def ttl_days(category) -> Column:
    """Base TTL days of a category; NULL for rule categories and unknowns."""
    m = F.create_map(*[x for k, v in S.TTL_DAYS.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, _c(category))


def expiry(category, priority, base) -> Column:
    """``base + int(days * multiplier)`` days, or NULL (never expires)."""
    p = _c(priority)
    days = ttl_days(category)
    n = F.when(p >= S.RULE_PRIORITY_FLOOR, F.lit(None).cast("int")).when(
        p == 1, F.floor(days * F.lit(S.TTL_MULTIPLIER_P1)).cast("int")).otherwise(days)
    return F.when(n.isNotNull(), F.timestamp_add("DAY", n, _c(base)))


def rule_priority(category, priority) -> Column:
    """Rules get at least priority 2."""
    p = _c(priority)
    return F.when(_c(category).isin(*S.RULE_CATEGORIES),
                  F.greatest(p, F.lit(S.RULE_PRIORITY_FLOOR))).otherwise(p)


def tokens(content) -> Column:
    """``max(1, len // 4)`` with length in code points."""
    return F.greatest(F.lit(1), F.floor(F.length(_c(content)) / S.CHARS_PER_TOKEN).cast("int"))


def embedding_text(title, content) -> Column:
    """Text handed to the embedder."""
    return F.concat(_c(title), F.lit("\n"), _c(content))


def note_id(*parts) -> Column:
    """E14, repeatable form: a UUID-shaped id derived from a hash of the parts."""
    h = F.sha2(F.concat_ws("\u0001", *[_c(p).cast("string") for p in parts]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.concat(F.lit("4"), F.substring(h, 14, 3)),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def metadata_json(m) -> Column:
    """E15 encode: a map/struct to JSON text; empty or NULL -> NULL (store rule)."""
    j = F.to_json(_c(m))
    return F.when(j.isNull() | j.isin("{}", "null"), F.lit(None).cast("string")).otherwise(j)


def json_value(c) -> Column:
    """E15 decode: JSON text (metadata, audit details) to a VARIANT. NULL, empty
    text and text that is no JSON give NULL; the JSON ``null`` is a variant of
    its own (``is_variant_null``)."""
    t = strip_ws(_c(c))
    return F.when(t != "", F.try_parse_json(t))


def json_field(c, path: str, kind: str = "string") -> Column:
    """E15 decode of one field of a JSON text: the value at ``path`` (as in
    ``$.a.b[0]``) as ``kind``, NULL where it is missing or does not fit."""
    return F.try_variant_get(json_value(c), path, kind)


def json_kind(c) -> Column:
    """What a JSON text holds: ``object``, ``array``, ``string``, ``number``,
    ``boolean``, ``null``, or NULL for no JSON."""
    k = F.schema_of_variant(json_value(c))
    return (F.when(k.startswith("OBJECT"), "object").when(k.startswith("ARRAY"), "array").when(k == "STRING", "string")
            .when(k == "BOOLEAN", "boolean").when(k == "VOID", "null").when(k.isNotNull(), "number"))


# ------------------------------------------------------------------ N1-N3

def slugify(text) -> Column:
    """Lower, strip, keep [a-z0-9], whitespace and '-', whitespace runs to
    '-', collapse '-', trim '-'. Underscores are dropped by the first rule."""
    s = strip_ws(F.lower(_c(text)))
    s = F.regexp_replace(s, f"[^a-z0-9{WS_CHARS}-]", "")
    s = F.regexp_replace(s, f"[{WS_CHARS}_]+", "-")
    s = F.regexp_replace(s, "-+", "-")
    return F.regexp_replace(s, r"\A-+|-+\z", "")


def valid_slug(s) -> Column:
    """``^[a-z0-9][a-z0-9-]*[a-z0-9]$`` or one ``[a-z0-9]`` (Python '$'
    also accepts one trailing newline)."""
    return _c(s).rlike(r"\A(?:[a-z0-9][a-z0-9-]*[a-z0-9]|[a-z0-9])\n?\z")


def file_slug(title, max_len: int = S.FILE_SLUG_MAX) -> Column:
    """Slug cut to ``max_len`` after trimming, so it may end in '-'."""
    return F.substring(slugify(title), 1, max_len)
