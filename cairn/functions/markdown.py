"""Markdown note files as column expressions (N4 parse, N5 render).

File layout (front matter, title heading, summary quote, content, related
list) and the parse rules follow the reference's exporter/importer,
including its lossy spots (Q16): an all-digit value becomes a number, a
bracketed value becomes a list, body text after a line starting
``## Related`` is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn import schema as S
from cairn.functions.text import WS, strip_ws
from cairn.operators.listing import ts_text

# Front matter then body; DOTALL; Python's `\s` spelled out.
FRONT_RE = f"(?s)\\A---{WS}*\\n(.*?)\\n---{WS}*\\n(.*)\\z"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def json_string(c: Column) -> Column:
    """``json.dumps`` of a text: quoted, with backslash, quote and control
    characters escaped (non-ASCII is kept as is)."""
    s = F.regexp_replace(c, r"\\", r"\\\\")
    s = F.regexp_replace(s, '"', '\\\\"')
    s = F.regexp_replace(s, "\n", "\\\\n")
    s = F.regexp_replace(s, "\r", "\\\\r")
    s = F.regexp_replace(s, "\t", "\\\\t")
    return F.concat(F.lit('"'), s, F.lit('"'))


def render(id_, category, title, status, priority, tags, entities, source, expires_at, created_at,
           updated_at, metadata, summary, content, related_ids) -> Column:
    """The Markdown text of one note. Optional front-matter fields appear
    only when set (lists only when non-empty)."""
    def opt(cond, *parts):
        return F.when(cond, F.array(F.concat(*parts))).otherwise(F.array().cast("array<string>"))

    tags, entities, related = (F.coalesce(_c(x), F.array().cast(S.STR_ARRAY)) for x in (tags, entities, related_ids))
    src, exp, cre, upd, meta, summ = (_c(x) for x in (source, expires_at, created_at, updated_at, metadata, summary))
    head = F.array(
        F.lit("---"),
        F.concat(F.lit("id: "), _c(id_)),
        F.concat(F.lit("category: "), _c(category)),
        F.concat(F.lit('title: "'), _c(title), F.lit('"')),
        F.concat(F.lit("status: "), _c(status)),
        F.concat(F.lit("priority: "), _c(priority).cast("string")))
    lines = F.concat(
        head,
        opt(F.size(tags) > 0, F.lit("tags: ["), F.array_join(tags, ", "), F.lit("]")),
        opt(F.size(entities) > 0, F.lit("entities: ["), F.array_join(entities, ", "), F.lit("]")),
        opt(src.isNotNull() & (src != ""), F.lit("source: "), src),
        opt(exp.isNotNull(), F.lit("expires_at: "), ts_text(exp)),
        opt(cre.isNotNull(), F.lit("created_at: "), ts_text(cre)),
        opt(upd.isNotNull(), F.lit("updated_at: "), ts_text(upd)),
        opt(meta.isNotNull() & (meta != ""), F.lit("metadata: "), json_string(meta)),
        F.array(F.lit("---"), F.lit(""), F.concat(F.lit("# "), _c(title)), F.lit("")),
        F.when(summ.isNotNull() & (summ != ""), F.array(F.concat(F.lit("> "), summ), F.lit("")))
         .otherwise(F.array().cast("array<string>")),
        F.array(F.coalesce(_c(content), F.lit("")), F.lit("")),
        F.when(F.size(related) > 0, F.concat(
            F.array(F.lit("## Related")), F.transform(related, lambda r: F.concat(F.lit("- "), r)), F.array(F.lit(""))))
         .otherwise(F.array().cast("array<string>")),
    )
    return F.array_join(lines, "\n")


def render_row() -> Column:
    """``render`` over the standard note columns."""
    return render("id", "category", "title", "status", "priority", "tags", "entities", "source",
                  "expires_at", "created_at", "updated_at", "metadata", "summary", "content", "related_ids")


def _front_value(entries: Column, key: str) -> Column:
    """The last value given for ``key`` in the parsed front matter."""
    hits = F.filter(entries, lambda e: e["k"] == key)
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["v"])


def _entries(front: Column) -> Column:
    """Front-matter ``key: value`` pairs (lambdas see only their element)."""
    raw = F.split(strip_ws(front), "\n", -1)
    lines_kv = F.filter(F.transform(raw, lambda l: strip_ws(l)), lambda l: F.instr(l, ":") > 0)
    entries = F.transform(lines_kv, lambda l: F.struct(
        strip_ws(F.substring_index(l, ":", 1)).alias("k"),
        strip_ws(F.regexp_replace(l, r"\A[^:]*:", "")).alias("v")))
    # Strip one pair of surrounding double quotes.
    return F.transform(entries, lambda e: F.struct(
        e["k"].alias("k"),
        F.when(e["v"].startswith('"') & e["v"].endswith('"'),
               F.regexp_replace(F.regexp_replace(e["v"], r'\A"', ""), r'"\z', "")).otherwise(e["v"]).alias("v")))


def _staged_content(df, body_col: str, out: str):
    """The importer's content rule on a stripped body column, one stage per
    intermediate (each a column, so nothing is re-evaluated) and with array
    slices only (no lambda refers to anything but its own element)."""
    e = F.array().cast(S.STR_ARRAY)
    df = df.withColumn("_l", F.split(F.col(body_col), "\n", -1))
    df = (df.withColumn("_n", F.size("_l"))
          .withColumn("_t", F.array_position(F.transform("_l", lambda l: l.startswith("# ")), True).cast("int"))
          .withColumn("_b", F.transform("_l", lambda l: l.rlike(f"\\A{WS}*\\z"))))
    # first non-blank line after the title, as an absolute index (0 = none)
    df = df.withColumn("_r", F.array_position(
        F.slice("_b", F.greatest(F.col("_t") + 1, F.lit(1)), F.greatest(F.col("_n") - F.col("_t"), F.lit(1))),
        False).cast("int"))
    df = df.withColumn("_s", F.when((F.col("_t") > 0) & (F.col("_t") < F.col("_n")) & (F.col("_r") > 0),
                                    F.col("_t") + F.col("_r")).otherwise(F.lit(0)))
    df = df.withColumn("_q", F.when(F.col("_s") > 0, F.element_at("_l", F.greatest(F.col("_s"), F.lit(1)))
                                    .startswith("> ")).otherwise(F.lit(False)))
    df = df.withColumn("_k", F.when(F.col("_s") == 0, F.col("_n")).when(F.col("_q"), F.col("_s"))
                       .otherwise(F.col("_s") - 1))
    before = F.when(F.col("_t") > 1, F.slice("_l", 1, F.greatest(F.col("_t") - 1, F.lit(1)))).otherwise(e)
    after = F.when(F.col("_k") < F.col("_n"),
                   F.slice("_l", F.least(F.col("_k") + 1, F.col("_n")), F.greatest(F.col("_n") - F.col("_k"), F.lit(1)))
                   ).otherwise(e)
    df = df.withColumn("_kept", F.when(F.col("_t") == 0, F.col("_l")).otherwise(F.concat(before, after)))
    df = df.withColumn("_stop", F.array_position(F.transform("_kept", lambda l: l.startswith("## Related")),
                                                  True).cast("int"))
    kept = F.when(F.col("_stop") == 1, e).when(
        F.col("_stop") > 1, F.slice("_kept", 1, F.greatest(F.col("_stop") - 1, F.lit(1)))).otherwise(F.col("_kept"))
    return df.withColumn(out, strip_ws(F.array_join(kept, "\n"))).drop(
        "_l", "_n", "_t", "_b", "_r", "_s", "_q", "_k", "_kept", "_stop")


def _parsed(ok: Column, entries: Column, content: Column) -> Column:

    def as_list(v: Column) -> Column:
        inner = strip_ws(F.regexp_replace(F.regexp_replace(v, r"\A\[", ""), r"\]\z", ""))
        return F.when(v.startswith("[") & v.endswith("]"),
                      F.when(inner == "", F.array().cast(S.STR_ARRAY))
                      .otherwise(F.transform(F.split(inner, ",", -1), lambda x: strip_ws(x))))

    def is_digits(v: Column) -> Column:
        return v.rlike(r"\A\p{Nd}+\z")

    title_v = _front_value(entries, "title")
    prio_v = _front_value(entries, "priority")
    tags_v = _front_value(entries, "tags")
    prio = F.when(is_digits(prio_v), prio_v.try_cast("int"))
    parsed = F.struct(
        _front_value(entries, "id").alias("id"),
        _front_value(entries, "category").alias("category"),
        # str(int(v)) for any length: drop leading zeros, keep one digit
        F.when(is_digits(title_v), F.regexp_replace(title_v, r"\A0+(?=\p{Nd})", "")).otherwise(title_v).alias("title"),
        is_digits(title_v).alias("title_is_number"),
        (title_v.startswith("[") & title_v.endswith("]")).alias("title_is_list"),
        _front_value(entries, "status").alias("status"),
        prio.alias("priority"),
        (prio_v.isNotNull() & prio.isNull()).alias("priority_not_number"),
        as_list(tags_v).alias("tags"),
        # empty and zero count as no tags; other text or numbers are no list
        (tags_v.isNotNull() & as_list(tags_v).isNull() & (tags_v != "") & ~tags_v.rlike(r"\A0+\z")).alias("tags_not_list"),
        _front_value(entries, "source").alias("source"),
        _front_value(entries, "metadata").alias("metadata"),
        content.alias("content"))
    return F.when(ok, parsed)


def parse_df(df, text_col: str, out: str = "parsed"):
    """Add a struct column ``out`` with the importer's fields, or NULL
    when the text has no front matter.

    Fields: id, category, title, status, source, metadata (strings; a value
    in double quotes loses them), priority (int when all digits), tags (list
    when bracketed), title_is_number / title_is_list / priority_not_number / tags_not_list flags, content (the
    body without its first '# ' heading, the blank lines and one '> ' line
    after it, and everything from the first kept line starting '## Related').

    A staged transform: front matter, body and each line-level intermediate
    are computed once as their own columns."""
    t = F.col(text_col)
    staged = (df.withColumn("_md_ok", t.rlike(FRONT_RE))
              .withColumn("_md_front", F.regexp_extract(t, FRONT_RE, 1))
              .withColumn("_md_body", strip_ws(F.regexp_extract(t, FRONT_RE, 2))))
    staged = staged.withColumn("_md_entries", _entries(F.col("_md_front")))
    staged = _staged_content(staged, "_md_body", "_md_content")
    return staged.withColumn(out, _parsed(F.col("_md_ok"), F.col("_md_entries"), F.col("_md_content"))) \
        .drop("_md_ok", "_md_front", "_md_body", "_md_entries", "_md_content")
