"""Elements and texts of HTML columns. Pages are walked in Arrow workers (functions/page_nodes.py), one walk per page and expression.

Selectors are ``tag``, ``.class``, ``tag.class``, ``[attr]``, ``[attr='v']``, ``[attr*='v']``, any of them inside others
(``table.x tr``), and comma lists. Elements come back in page order, each once, nested ones included. A walk keeps a stack, which
Spark's own functions can only fold over in interpreted lambdas: written that way it took 2.7 ms for a page of 900 characters, in
workers it takes 0.1 ms. Whatever follows the walk is a Spark expression.
"""

from __future__ import annotations

from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.functions.page_nodes import Page, parse_selector
from marquee.functions.text import clean_text

TEXT, STRIPPED, OUTER = "text", "stripped", "outer"


def _reader(what: str):
    """How a value is taken from an element: its text, its text stripped part by part, its HTML, or (``@name``) an attribute."""
    if what.startswith("@"):
        return lambda page, at: page.attributes(at).get(what[1:], "")
    return {TEXT: Page.text, STRIPPED: Page.stripped_text, OUTER: Page.outer}[what]


def _lists(groups: list[list], kind: pa.DataType) -> pa.Array:
    """list<kind> of groups, from one flat array and offsets: Arrow takes nested Python lists several times more slowly."""
    return _grouped([len(g) for g in groups], pa.array([*chain.from_iterable(groups)], kind))


def _grouped(sizes: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([*accumulate(sizes, initial=0)], pa.int32()), values)


def select_fields(html: Column, fields: dict[str, tuple[str, str]]) -> Column:
    """struct<name: array<string>> of what each named (selector, what) finds on the page; empty arrays for NULL. One walk for all fields."""
    wanted = [(name, parse_selector(selector), _reader(what)) for name, (selector, what) in fields.items()]

    @F.arrow_udf("struct<" + ",".join(f"`{name}`:array<string>" for name in fields) + ">")
    def read(pages: pa.Array) -> pa.Array:
        found: dict[str, list] = {name: [] for name, _, _ in wanted}
        for source in pages.to_pylist():
            page = Page(source or "")
            for name, selector, value in wanted:
                found[name].append([value(page, at) for at in page.find(selector)])
        return pa.StructArray.from_arrays([_lists(found[name], pa.string()) for name in fields], [*fields])

    return read(html)


def select_all(html: Column, selector: str, what: str = OUTER) -> Column:
    """Of all matching elements, in page order, the HTML as written (or another ``what``), as array<string>."""
    return select_fields(html, {"found": (selector, what)})["found"]


def select_first(html: Column, selector: str, what: str = OUTER) -> Column:
    """The same of the first matching element, '' if there is none."""
    return F.coalesce(F.get(select_all(html, selector, what), F.lit(0)), F.lit(""))


BLOCKS = "array<struct<title_jp:string,src:string,cells:array<array<string>>,times:array<string>>>"


def read_page(html: Column, rule: Column) -> Column:
    """struct<blocks, bare> of a page by the selectors of a rule (block, title, row, time: strings; fallback: array).

    Of each block: the first title's text, the first image's address (NULL without one), the texts of the cells of each row of
    two or more (the first cell's stripped part by part), and the texts of the times. ``bare``: the texts under each fallback selector.
    """
    image, data = parse_selector("img[src]"), parse_selector("td")

    @F.arrow_udf(f"struct<blocks:{BLOCKS},bare:array<array<string>>>")
    def read(pages: pa.Array, rules: pa.Array) -> pa.Array:
        parsed = {}

        def selector(text: str) -> list:
            if text not in parsed:
                parsed[text] = parse_selector(text)
            return parsed[text]

        def cells(page: Page, row: int) -> list[str]:
            found = page.find(data, row + 1, page.ends[row])
            return [page.stripped_text(c) if i == 0 else page.text(c) for i, c in enumerate(found)] if len(found) >= 2 else []

        # per page: blocks and texts under each fallback; per block: title, image, rows of cells, times
        titles, images, times, bare = [], [], [], []
        blocks, selectors, rows, row_cells = [], [], [], []
        for source, block, title, row, time, fallback in zip(pages.to_pylist(), *(f.to_pylist() for f in rules.flatten())):
            page = Page(source or "")
            found = page.find(selector(block))
            blocks.append(len(found))
            for at in found:
                inside = at + 1, page.ends[at]
                first_title, first_image = page.find(selector(title), *inside)[:1], page.find(image, *inside)[:1]
                titles.append(page.text(first_title[0]) if first_title else "")
                images.append(page.attributes(first_image[0])["src"] if first_image else None)
                held = [] if row is None else [c for c in (cells(page, r) for r in page.find(selector(row), *inside)) if c]
                rows.append(len(held))
                row_cells += held
                times.append([] if time is None else [page.text(t) for t in page.find(selector(time), *inside)])
            selectors.append(len(fallback))
            bare += [[page.text(at) for at in page.find(selector(s))] for s in fallback]
        text = pa.string()
        of_blocks = pa.StructArray.from_arrays(
            [pa.array(titles, text), pa.array(images, text), _grouped(rows, _lists(row_cells, text)), _lists(times, text)], ["title_jp", "src", "cells", "times"])
        return pa.StructArray.from_arrays([_grouped(blocks, of_blocks), _grouped(selectors, _lists(bare, text))], ["blocks", "bare"])

    return read(html, F.struct(*[rule[f].alias(f) for f in ("block", "title", "row", "time", "fallback")]))


def text_of(html: Column) -> Column:
    """Text content of an element's HTML."""
    return select_whole(html, TEXT)


def clean_text_of(html: Column) -> Column:
    return clean_text(text_of(html))


def attribute(element: Column, name: str) -> Column:
    """Value of an attribute of the element's own start tag, '' if absent."""
    return select_whole(element, f"@{name}")


def select_whole(html: Column, what: str) -> Column:
    """A value of the element that the HTML begins with; '' for text without elements, except its text."""
    value = _reader(what)

    @F.arrow_udf("string")
    def read(elements: pa.Array) -> pa.Array:
        def of(source: str) -> str:
            page = Page(source)
            if what == TEXT:
                return "".join(page.texts)
            return value(page, 0) if page.tags else ""

        return pa.array((of(e.as_py() or "") for e in elements), pa.string())

    return read(html)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---- addresses

def resolve_url(base: Column, link: Column) -> Column:
    """Absolute form of a link found on a page below ``base``."""

    def resolved(u: Column) -> Column:
        page, to = u["base"], u["link"]
        origin = F.regexp_extract(page, r"\A[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
        no_query = F.regexp_replace(page, r"[?#].*\z", "")
        folder = F.regexp_replace(F.substr(no_query, F.length(origin) + 1), r"[^/]*\z", "")
        folder = F.when(folder == "", F.lit("/")).otherwise(folder)
        target = F.when(to.startswith("/"), to).otherwise(F.concat(folder, to))
        return (
            F.when(to == "", page)
            .when(to.rlike(r"\A[a-zA-Z][a-zA-Z0-9+.-]*:"), to)
            .when(to.startswith("//"), F.concat(F.regexp_extract(page, r"\A[^:/]*:", 0), to))
            .when(to.startswith("#"), F.concat(F.regexp_replace(page, r"#.*\z", ""), to))
            .when(to.startswith("?"), F.concat(no_query, to))
            .otherwise(F.concat(origin, _without_dots(target))))

    return let(F.struct(base.alias("base"), link.alias("link")), resolved)


def _without_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments of a path that starts with '/'."""

    def step(done: Column, part: Column) -> Column:
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", shorter).when(part == ".", done).otherwise(F.array_append(done, part))

    def resolved(p: Column) -> Column:
        only_path = F.regexp_extract(p, r"\A[^?#]*", 0)
        segments = F.slice(F.split(only_path, "/"), F.lit(2), F.length(only_path) + 1)
        kept = F.aggregate(segments, F.expr("cast(array() as array<string>)"), step)
        closing = F.when(only_path.rlike(r"/\.\.?\z"), F.lit("/")).otherwise(F.lit(""))
        path = F.concat(F.lit("/"), F.array_join(kept, "/"))
        path = F.when(path.endswith("/"), path).otherwise(F.concat(path, closing))
        return F.when(only_path.rlike(r"/\.\.?(?:/|\z)"),
                      F.concat(path, F.substr(p, F.length(only_path) + 1))).otherwise(p)

    return let(path, resolved)


def absolute_link(link: Column, base: Column, join_links) -> Column:
    """A link that starts with 'http' as it is, others resolved against the base or, without ``join_links``, appended to it."""
    join_links = join_links if isinstance(join_links, Column) else F.lit(join_links)
    return F.when(link.startswith("http"), link).when(join_links, resolve_url(base, link)).otherwise(F.concat(base, link))
