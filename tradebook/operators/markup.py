"""Pages as tables of elements: each page is parsed once, selectors are Column expressions over its rows.

Elements are numbered in document order (``pre``); the descendants of an element are those numbered up to its
``last``, so "inside" is an interval condition. Texts are the page's pieces in order, and an element's own
text is an interval of them. The parser is the only step in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradebook.functions.base import let, strip, words

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "footer", "form", "h1",
          "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "section", "table", "tr",
          "ul"}
_HIDDEN = {"script", "style", "head", "title", "template", "noscript"}
_STEP = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)
                       |\[(?P<attr>[\w-]+)(?:(?P<op>[*^$~]?=)['"]?(?P<val>[^'"\]]*)['"]?)?\]""", re.X)

#: Markup that is parsed and handed on together: elements take some fifty times its bytes in Python.
PORTION_BYTES = 1 << 20
PORTION_ROWS = 1000

#: pre, last, up: own number, that of the last descendant, that of the parent (-1: none); first and end: the
#: element's interval of pieces; link: the href resolved against the page's URL.
NODE = T.StructType([T.StructField(c, T.IntegerType()) for c in ("pre", "last", "up", "first", "end")] + [
    T.StructField("tag", T.StringType()), T.StructField("link", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType()))])
#: A piece of text, or a null for a line break at the edge of a block; hidden: the innermost hidden element
#: around it (-1: none).
PIECE = T.StructType([T.StructField("text", T.StringType()), T.StructField("hidden", T.IntegerType())])


class _Rows(HTMLParser):
    """Elements and pieces of one page. End tags close everything inside; stray ones are ignored."""

    def __init__(self, url: str, tags: frozenset[str] | None):
        super().__init__(convert_charrefs=True)
        self.url, self.tags = url, tags
        self.nodes: list[list] = []
        self.pieces: list[tuple[str | None, int]] = []
        self.open: list[tuple[int, int]] = [(-1, -1)]       # number, innermost hidden element

    def handle_starttag(self, tag, attrs):
        first: dict[str, str] = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        up, hidden = self.open[-1]
        if tag in _BLOCK:
            self.pieces.append((None, hidden))
        number = len(self.nodes)
        self.nodes.append([number, up, len(self.pieces), number, 0, tag, self._link(first.get("href")), first])
        self.open.append((number, number if tag in _HIDDEN else hidden))
        if tag in _VOID:
            self._close()

    def _link(self, href: str | None) -> str | None:
        try:
            return None if href is None else urljoin(self.url, href)
        except ValueError:
            return None

    def _close(self) -> None:
        number, _ = self.open.pop()
        node = self.nodes[number]
        node[3], node[4] = len(self.nodes) - 1, len(self.pieces)
        if node[5] in _BLOCK:
            self.pieces.append((None, self.open[-1][1]))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close()

    def handle_endtag(self, tag):
        depth = next((k for k in range(len(self.open) - 1, 0, -1) if self.nodes[self.open[k][0]][5] == tag), None)
        if depth is not None:
            while len(self.open) > depth:
                self._close()

    def handle_data(self, data):
        self.pieces.append((data, self.open[-1][1]))

    def finish(self) -> tuple[list[list], list[tuple[str | None, int]]]:
        self.close()
        while len(self.open) > 1:
            self._close()
        wanted = self.nodes if self.tags is None else [n for n in self.nodes if n[5] in self.tags]
        return wanted, self.pieces


def _lists(rows: list[list | None], arrays: list[pa.Array], names: list[str]) -> pa.Array:
    """A list column of structs; a null row stays null."""
    offsets, at = [], 0
    for r in rows:
        offsets.append(at)
        at += len(r or ())
    struct = pa.StructArray.from_arrays(arrays, names)
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), struct,
                                    mask=pa.array([r is None for r in rows], pa.bool_()))


def _portions(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
    """The rows of a batch in portions of about ``PORTION_BYTES`` of markup."""
    start, held = 0, 0
    for at, size in enumerate(pc.binary_length(batch.column("_html")).to_pylist()):
        if at > start and (held + (size or 0) > PORTION_BYTES or at - start == PORTION_ROWS):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size or 0
    if batch.num_rows:
        yield batch.slice(start)


def with_elements(pages: DataFrame, likely: Column, keep: Sequence[str], tags: Sequence[str] | None = None,
                  texts: bool = True) -> DataFrame:
    """The columns ``keep`` of the pages with ``nodes`` and ``pieces``; nulls where a page is not ``likely``.

    With ``tags`` only such elements are listed (numbers stay those of the page); without ``texts`` pieces are empty.
    """
    names, wanted = list(keep), None if tags is None else frozenset(tags)
    bare = pages.select(*keep, F.coalesce("url", F.lit("")).alias("_url"), F.when(likely, F.col("html")).alias("_html"))
    schema = T.StructType([*[bare.schema[c] for c in keep], T.StructField("nodes", T.ArrayType(NODE)),
                           T.StructField("pieces", T.ArrayType(PIECE))])

    def read(url: str, html: str | None) -> tuple[list | None, list | None]:
        if html is None:
            return None, None
        parser = _Rows(url, wanted)
        parser.feed(html)
        nodes, pieces = parser.finish()
        return nodes, pieces if texts else []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in (portion for whole in batches for portion in _portions(whole)):
            found = [read(u.as_py(), h.as_py()) for u, h in zip(batch.column("_url"), batch.column("_html"), strict=True)]
            nodes, pieces = [f[0] for f in found], [f[1] for f in found]
            flat = [n for page in nodes for n in page or ()]
            bits = [p for page in pieces for p in page or ()]
            whole = {c: pa.array([n[k] for n in flat], pa.int32()) for k, c in enumerate(("pre", "up", "first", "last", "end"))}
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:-2],
                _lists(nodes, [whole[c] for c in ("pre", "last", "up", "first", "end")] + [
                    pa.array([n[5] for n in flat], pa.string()), pa.array([n[6] for n in flat], pa.string()),
                    pa.array([list(n[7].items()) for n in flat], pa.map_(pa.string(), pa.string()))], NODE.fieldNames()),
                _lists(pieces, [pa.array([p[0] for p in bits], pa.string()), pa.array([p[1] for p in bits], pa.int32())],
                       PIECE.fieldNames())], [*names, "nodes", "pieces"])

    return bare.mapInArrow(run, schema)


# --- elements ----------------------------------------------------------------------------------------------------------
def attribute(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))


def inside(node: Column) -> Column:
    """The descendants of an element of a full element list, in document order."""
    return F.slice("nodes", node["pre"] + 2, node["last"] - node["pre"])


def strings(node: Column) -> Column:
    """The pieces of text of an element and its descendants, in order."""
    own = F.slice("pieces", node["first"] + 1, node["end"] - node["first"])
    return F.transform(F.filter(own, lambda p: p["text"].isNotNull()), lambda p: p["text"])


def joined_text(node: Column) -> Column:
    """Stripped pieces put together without a separator."""
    return F.array_join(F.transform(strings(node), strip), "")


def shown_text(node: Column) -> Column:
    """Text as displayed: hidden elements left out, lines at block edges, white space collapsed inside a line."""
    own = F.filter(F.slice("pieces", node["first"] + 1, node["end"] - node["first"]), lambda p: p["hidden"] <= node["pre"])
    flowing = F.array_join(F.transform(own, lambda p: F.coalesce(F.replace(p["text"], F.lit("\n"), F.lit(" ")), F.lit("\n"))), "")
    lines = F.transform(F.split(flowing, "\n"), lambda x: F.array_join(words(x), " "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _compile(selector: str) -> list[tuple[str, list[dict]]]:
    """[(combinator, tests)] from left to right; combinators are '' , ' ' and '>'."""
    steps, link = [], ""
    for token in re.sub(r"\s*>\s*", " > ", selector.strip()).split():
        if token == ">":
            link = ">"
            continue
        steps.append((link if steps else "", [m.groupdict() for m in _STEP.finditer(token)]))
        link = " "
    return steps


def literals(selector: str) -> list[str]:
    """Lower-case texts that must occur in the markup for the selector to match anything."""
    out = []
    for _, tests in _compile(selector):
        for t in tests:
            if t["tag"] and t["tag"] != "*":
                out.append("<" + t["tag"])
            out += [t[k] for k in ("cls", "id", "attr", "val") if t[k]]
    return [x.lower() for x in dict.fromkeys(out)]


def _passes(node: Column, tests: list[dict]) -> Column:
    out = F.lit(True)
    for t in tests:
        if t["tag"]:
            ok = F.lit(True) if t["tag"] == "*" else node["tag"] == t["tag"]
        elif t["cls"]:
            ok = F.array_contains(words(attribute(node, "class")), t["cls"])
        elif t["id"]:
            ok = attribute(node, "id") == t["id"]
        else:
            have, want = attribute(node, t["attr"]), F.lit(t["val"] or "")
            ok = have.isNotNull() if t["op"] is None else {
                "=": have == want, "*=": have.contains(want), "^=": have.startswith(want), "$=": have.endswith(want),
                "~=": F.array_contains(words(have), want)}[t["op"]]
        out = out & ok
    return F.coalesce(out, F.lit(False))


def _fits(node: Column, steps: list[tuple[str, list[dict]]], at: int) -> Column:
    link, tests = steps[at]
    here = _passes(node, tests)
    if at == 0:
        return here
    if link == ">":
        above = F.when(node["up"] >= 0, let(F.get("nodes", node["up"]), lambda up: _fits(up, steps, at - 1))).otherwise(False)
    else:
        above = F.exists("nodes", lambda up: (up["pre"] < node["pre"]) & (up["last"] >= node["pre"]) & _fits(up, steps, at - 1))
    return here & above


def selected(selector: str) -> Column:
    """The elements of ``nodes`` that a selector names, in document order."""
    steps = _compile(selector)
    return F.filter("nodes", lambda n: _fits(n, steps, len(steps) - 1))


def has_class_rule(node: Column, rule: tuple) -> Column:
    """Test of a (tag, attribute, kind, value, ancestor) address pattern."""
    tag, attr, kind, value = rule[:4]
    out = F.lit(True) if tag == "*" else node["tag"] == tag
    if attr is not None:
        have = attribute(node, attr)
        out = out & F.coalesce(have.contains(F.lit(value)) if kind == "contains" else have == value, F.lit(False))
    above = rule[4] if len(rule) > 4 else None
    if above is None:
        return out
    return out & F.exists("nodes", lambda up: (up["pre"] < node["pre"]) & (up["last"] >= node["pre"]) & has_class_rule(up, above))
