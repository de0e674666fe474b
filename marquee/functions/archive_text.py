"""Columns over archived reports: names, titles, published form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions import fixed_values as fv
from marquee.functions.text import missing_as_null, strip_text

LINE_BREAK = r"\R|[\x1c-\x1e]"


def issue_filename(issue_number: Column, day: Column) -> Column:
    return F.format_string(fv.ISSUE_NAME, issue_number.cast("long"), F.date_format(day, "yyyy-MM-dd"))


def valid_name(c: Column) -> Column:
    r"""Whole-string match; \z, unlike $, does not let a final newline through."""
    return c.rlike(r"\A" + fv.ARCHIVE_NAME + r"\z")


def issue_of_name(c: Column) -> Column:
    return F.regexp_extract(c, r"briefing_(\d+)_", 1).try_cast("long")


def extract_title(markdown: Column, default: str) -> Column:
    """Text of the first line that, stripped, starts with '# '."""
    lines = F.transform(F.split(markdown, LINE_BREAK), strip_text)
    heading = F.try_element_at(F.filter(lines, lambda l: l.startswith("# ")), F.lit(1))
    return F.coalesce(strip_text(F.substring(heading, 3, 2_000_000_000)), F.lit(default))


def restyle_headings(html: Column) -> Column:
    """Plain one-line h1-h3 become styled paragraphs; the whole is wrapped in one div."""
    body = html
    for tag, style in fv.HEADING_STYLES.items():
        body = F.regexp_replace(body, f"<{tag}>([^\\n]*?)</{tag}>", f'<p style="{style}">$1</p>')
    return F.concat(F.lit(f'<div style="{fv.ARTICLE_STYLE}">'), body, F.lit("</div>"))


def draft_payload(title: Column, author: Column, digest: Column, content: Column,
                  thumb_media_id: Column | None = None) -> Column:
    """JSON body of one draft; the thumb id is left out when missing."""
    fields = [
        title.alias("title"),
        author.alias("author"),
        F.coalesce(missing_as_null(digest), title).alias("digest"),
        content.alias("content"),
        F.lit("").alias("content_source_url"),
        F.lit(0).alias("need_open_comment"),
        F.lit(0).alias("only_fans_can_comment"),
    ]
    if thumb_media_id is not None:
        fields.append(missing_as_null(thumb_media_id).alias("thumb_media_id"))
    return F.to_json(F.struct(F.array(F.struct(*fields)).alias("articles")))
