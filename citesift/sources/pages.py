"""Article fields from fetched HTML pages, by tag, class, id and place.

A page is cut into tags and texts once. A fold over its tags keeps the stack of open
elements, so an element ends at its own closing tag however many of its name lie
inside it, at the end of an element around it, or, for the few elements that need no
closing tag, where the next one begins. All of it is Catalyst expressions.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The entities decoded in element text; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))

# Fixed values of HTML: elements without content, elements that stand on lines of their own.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCKS = (
    "address", "article", "aside", "blockquote", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
# Fixed values of HTML: what an opening tag ends if it is still open, unless one of the others was opened since.
ENDS = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table",)),
    "th": (("td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
# A paragraph ends where any block begins.
PARAGRAPH = (("p",), ("table", "button", "td", "th", "li"))

# Comments, scripts and styles whole, with no tags inside; tags with quoted values; text; a stray bracket.
TOKEN = (
    r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)"
    r"|</?[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[!?][^>]*>|[^<]++|<"
)
# Stands for a line break while the pieces are put together.
BREAK = "\x01"


@dataclass(frozen=True)
class Selector:
    """Elements of a tag (any if none), with the class or id if given.

    With ``inside``, only within an element of that kind; ``path`` then names the
    elements from that one down to the selected one's parent, each the child of the
    one before. Without it any depth will do.
    """

    tag: str | None = None
    css_class: str | None = None
    element_id: str | None = None
    inside: Selector | None = None
    path: tuple[str, ...] | None = None

    def matches(self, name: Column, tag: Column) -> Column:
        """Whether an opening tag is of this kind, wherever it stands."""
        fits = F.lit(True)
        if self.tag:
            fits = fits & (name == self.tag.lower())
        if self.element_id:
            fits = fits & (_attribute(tag, "id") == self.element_id)
        if self.css_class:
            fits = fits & F.array_contains(F.split(_attribute(tag, "class"), r"\s+"), self.css_class)
        return fits


def _attribute(tag: Column, name: str) -> Column:
    """The value, quoted or not; empty if there is none."""
    found = rf"(?is)^<[a-z][^\s/>]*(?:\s+(?!{name}[\s=])[^\s=>/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?|/)*\s+{name}\s*=\s*"
    value = F.regexp_extract(tag, found + r"(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.regexp_replace(value, r"^[\"']|[\"']$", "")


def tokens(html: Column) -> Column:
    """Tags, comments and texts of a page in order."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def _name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][^\s/>]*)", 1))


def _is_tag(token: Column) -> Column:
    return token.rlike(r"^</?[a-zA-Z]") & ~token.rlike(r"(?i)^<(script|style)\b")


def _piece(token: Column) -> Column:
    """What a token gives to the text around it: its characters, a break or nothing."""
    text = F.translate(token, BREAK, "")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    breaks = _name(token).isin(*BLOCKS, "br")
    return (
        F.when(_is_tag(token) & breaks, F.lit(BREAK)).when(token.rlike("^<[a-zA-Z/!?]"), F.lit("")).otherwise(text)
    )


def _tags(cut: Column, selector: Selector) -> Column:
    """``at, name, opens, hit, home, ends, bounds`` of every tag; ``at`` is its place among the tokens."""
    placed = F.transform(cut, lambda token, at: F.struct(token.alias("token"), at.alias("at")))
    found = F.filter(placed, lambda t: _is_tag(t["token"]))
    strings = "array<string>"

    def implied(which: int, name: Column) -> Column:
        table = F.create_map(*[x for k, v in ENDS.items() for x in (F.lit(k), F.lit(list(v[which])))])
        block = F.when(name.isin(*BLOCKS), F.lit(list(PARAGRAPH[which])))
        return F.coalesce(F.try_element_at(table, name), block, F.lit([]).cast(strings))

    def described(t: Column) -> Column:
        token, name = t["token"], _name(t["token"])
        opens = ~token.startswith("</")
        return F.struct(
            t["at"].alias("at"),
            name.alias("name"),
            (opens & ~name.isin(*VOID) & ~token.endswith("/>")).alias("opens"),
            (opens & selector.matches(name, token)).alias("hit"),
            (opens & (selector.inside.matches(name, token) if selector.inside else F.lit(False))).alias("home"),
            F.when(opens, implied(0, name)).otherwise(F.array(name)).alias("ends"),
            F.when(opens, implied(1, name)).otherwise(F.lit([]).cast(strings)).alias("bounds"),
        )

    return F.transform(found, described)


def _placed(stack: Column, selector: Selector) -> Column:
    """Whether the place below these open elements is one the selector asks for."""
    if selector.inside is None:
        return F.lit(True)
    if selector.path is None:
        return F.exists(stack, lambda e: e["home"])
    # The last elements are the path, and the one before them is the place.
    n = F.size(stack)
    names = F.transform(F.slice(stack, F.greatest(n - len(selector.path) + 1, F.lit(1)), len(selector.path)), lambda e: e["name"])
    above = F.try_element_at(stack, -F.lit(len(selector.path) + 1))
    return F.coalesce((names == F.lit([p.lower() for p in selector.path])) & above["home"], F.lit(False))


def spans(cut: Column, selector: Selector) -> Column:
    """``start, end`` of every selected element: the places of its two tags among the tokens, in page order."""
    entry = "array<struct<name:string,at:int,hit:boolean,home:boolean>>"
    start = F.struct(
        F.array().cast(entry).alias("stack"), F.array().cast("array<struct<start:int,end:int>>").alias("found")
    )

    def closed(entries: Column, at: Column) -> Column:
        return F.transform(F.filter(entries, lambda e: e["hit"]), lambda e: F.struct(e["at"].alias("start"), at.alias("end")))

    def first(entries: Column, names: Column) -> Column:
        """How far down the stack the first element of those names is; 0 if there is none."""
        return F.array_position(F.transform(entries, lambda e: F.array_contains(names, e["name"])), True).cast("int")

    def step(state: Column, tag: Column) -> Column:
        downwards = F.reverse(state["stack"])
        end, bound = first(downwards, tag["ends"]), first(downwards, tag["bounds"])
        popped = F.when((bound == 0) | (end < bound), end).otherwise(0)
        left = F.slice(state["stack"], 1, F.size(state["stack"]) - popped)
        pushed = F.struct(
            tag["name"].alias("name"),
            tag["at"].alias("at"),
            (tag["hit"] & _placed(left, selector)).alias("hit"),
            tag["home"].alias("home"),
        )
        # A selected element without content is empty where it stands.
        empty = F.when(tag["hit"] & ~tag["opens"] & _placed(left, selector), F.array(F.struct(tag["at"], tag["at"])))
        return F.struct(
            F.when(tag["opens"], F.concat(left, F.array(pushed))).otherwise(left).alias("stack"),
            F.concat(
                state["found"],
                closed(F.slice(downwards, 1, popped), tag["at"]),
                F.coalesce(empty, F.array()).cast("array<struct<start:int,end:int>>"),
            ).alias("found"),
        )

    def finish(state: Column) -> Column:
        return F.array_sort(F.concat(state["found"], closed(state["stack"], F.size(cut))))

    return F.aggregate(_tags(cut, selector), start, step, finish)


def _texts(cut: Column, selector: Selector, between_blocks: str) -> Column:
    pieces = F.transform(cut, _piece)

    def text(span: Column) -> Column:
        inner = F.array_join(F.slice(pieces, span["start"] + 2, F.greatest(span["end"] - span["start"] - 1, F.lit(0))), "")
        if not between_blocks:
            return F.translate(inner, BREAK, "")
        # Blanks around a break are not shown, nor are breaks at the ends.
        apart = F.regexp_replace(inner, rf"[ \t\r\n]*{BREAK}[ \t\r\n{BREAK}]*", BREAK)
        return F.replace(F.regexp_replace(apart, rf"^{BREAK}|{BREAK}$", ""), F.lit(BREAK), F.lit(between_blocks))

    return F.transform(spans(cut, selector), text)


def element_texts(html: Column, selector: Selector, between_blocks: str = "") -> Column:
    """Text of every selected element with all it holds: tags, comments, scripts and styles
    left out, entities decoded, ``between_blocks`` put where one block ends or begins."""
    return _texts(tokens(html), selector, between_blocks)


def html_field(html: Column, selector: Selector, between_blocks: str = "") -> Column:
    """The texts of all selected elements run together; empty if there is none."""
    return F.array_join(element_texts(html, selector, between_blocks), "")


def html_list_field(html: Column, selector: Selector, between_blocks: str = "") -> Column:
    """The texts, each followed by ``;``."""
    return _listed(element_texts(html, selector, between_blocks))


def _listed(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda t: F.concat(t, F.lit(";"))), "")


def with_fields(
    pages: DataFrame,
    fields: Mapping[str, Selector],
    lists: Mapping[str, Selector] | None = None,
    between_blocks: str = "",
    html: str = "html",
) -> DataFrame:
    """Add ``fields`` as ``html_field`` and ``lists`` as ``html_list_field``, from one cut of each page."""
    cut = pages.withColumn("_cut", tokens(F.col(html)))
    columns = {name: F.array_join(_texts(F.col("_cut"), s, between_blocks), "") for name, s in fields.items()}
    columns |= {name: _listed(_texts(F.col("_cut"), s, between_blocks)) for name, s in (lists or {}).items()}
    return cut.withColumns(columns).drop("_cut")
