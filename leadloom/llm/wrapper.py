"""Main text of web pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import written
from leadloom.llm.dom import Element, Text, block_text, read

#: Page shapes folded together at a time.
FAN_IN = 64
#: Shapes gathered in a task before they are handed on.
GATHERED = 2_000
#: Pages of different content in which a text must stand alike, and nowhere otherwise, to be template;
#: on a host with fewer it must stand so in all of them, and in two at least.
MIN_PAGES = 5
#: The share of a host's pages of different content in which it must stand.
MIN_SHARE = 0.5
#: A page whose template would be longer than so many times its other text is a copy with a varying
#: remark, and keeps all its text; on a host of fewer than ``MIN_PAGES`` contents, longer than once.
MOST_TEMPLATE = 3
#: Neighbours that repeat as a row of up to so many labels are folded.
PERIOD = 4
#: Sibling lists whose lengths multiply to more are paired a row of the table at a time.
SMALL = 400
#: Wrappers up to this size in bytes are sent to every task; beyond it pages and wrappers are shuffled by host.
BROADCAST_BYTES = 32 << 20

# A shape is [label, children] for an element and ["", spots, places] for a text. A spot is the least
# and greatest hash of the texts that stand there and the pages that have it, or 0 once they differ;
# siblings folded in a page have a spot each, in their order. Places are those of the page's text
# nodes, one per spot, and only kept while a page is read. The root also has its number of pages.
Shape = list


def _is_text(shape: Shape) -> bool:
    return shape[0] == ""


def size(shape: Shape) -> int:
    return 1 if _is_text(shape) else 1 + sum(map(size, shape[1]))


def tree_matching(a: Shape, b: Shape) -> int:
    """Simple tree matching: most nodes that can be paired with order and ancestry kept."""
    if a[0] != b[0]:
        return 0
    if _is_text(a):
        return 1
    return 1 + sum(w for *_, w in _best_pairs(a[1], b[1], True))


def _best_pairs(left: list[Shape], right: list[Shape], weigh: bool = False) -> list[tuple[int, int, int]]:
    """Pairs of children, in order, with the greatest total matching, and their matching."""
    labels = [x[0] for x in left]
    if labels == [y[0] for y in right] and len(set(labels)) == len(labels):  # no other pairs are possible
        return [(i, i, tree_matching(x, y) if weigh else 1) for i, (x, y) in enumerate(zip(left, right, strict=True))]
    if len(left) * len(right) > SMALL:
        return _long_pairs(left, right)
    weights = [[tree_matching(x, y) for y in right] for x in left]
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left) - 1, -1, -1):
        for j in range(len(right) - 1, -1, -1):
            both = best[i + 1][j + 1] + weights[i][j] if weights[i][j] else 0
            best[i][j] = max(both, best[i + 1][j], best[i][j + 1])
    pairs, i, j = [], 0, 0
    while i < len(left) and j < len(right):
        if weights[i][j] and best[i][j] == best[i + 1][j + 1] + weights[i][j]:
            pairs.append((i, j, weights[i][j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return pairs


def _structure(shape: Shape) -> tuple:
    return () if _is_text(shape) else (shape[0], *map(_structure, shape[1]))


def _long_pairs(left: list[Shape], right: list[Shape]) -> list[tuple[int, int, int]]:
    """The pairs that the whole table gives, for long lists.

    Children that begin both lists alike are paired at once. Children of one structure share their
    weights, and only every so many rows of the table are kept; those between are made again on
    the way back, so memory grows with the root of one length times the other.
    """
    rows, columns = list(map(_structure, left)), list(map(_structure, right))
    start = 0
    while start < min(len(rows), len(columns)) and rows[start] == columns[start]:
        start += 1
    pairs = [(i, i, size(left[i])) for i in range(start)]
    n, m = len(left) - start, len(right) - start
    if not n or not m:
        return pairs
    kinds: dict[tuple, int] = {}
    column = np.array([kinds.setdefault(c, len(kinds)) for c in columns[start:]])
    first = {k: right[start + int(np.argmax(column == at))] for k, at in kinds.items()}
    known: dict[tuple, np.ndarray] = {}

    def weights(i: int) -> np.ndarray:
        """Of the i-th child with every kind of child on the right."""
        kind = rows[start + i]
        if kind not in known:
            known[kind] = np.array([tree_matching(left[start + i], y) for y in first.values()], dtype=np.int64)
        return known[kind]

    def above(i: int, below: np.ndarray) -> np.ndarray:
        w = weights(i)[column]
        row = below.copy()
        row[:m] = np.maximum(row[:m], np.where(w > 0, below[1:] + w, 0))
        return np.maximum.accumulate(row[::-1])[::-1]

    step = math.isqrt(n) + 1
    kept, row = {n: np.zeros(m + 1, dtype=np.int64)}, np.zeros(m + 1, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        row = above(i, row)
        if i % step == 0:
            kept[i] = row
    best: dict[int, np.ndarray] = {}
    i = j = 0
    while i < n and j < m:
        if i + 1 not in best or i not in best:
            end = min(n, i - i % step + step)
            best = {end: kept[end]}
            for at in range(end - 1, i - 1, -1):
                best[at] = above(at, best[at + 1])
        w = int(weights(i)[column[j]])
        if w and best[i][j] == best[i + 1][j + 1] + w:
            pairs.append((start + i, start + j, w))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return pairs


def _same_spot(x: list | int, y: list | int) -> list | int:
    return [x[0], x[0], x[2] + y[2]] if x and y and x[0] == x[1] == y[0] == y[1] else 0


def merge(a: Shape, b: Shape, same_page: bool = False) -> Shape:
    """One shape that both fit: paired nodes are one, the others stand in order.

    Texts of two pages meet spot by spot; those of one page stand behind each other in ``a``.
    """
    if _is_text(a):
        if same_page:
            a[1].extend(b[1])
            a[2].extend(b[2])
            return a
        both = min(len(a[1]), len(b[1]))
        spots = [_same_spot(x, y) for x, y in zip(a[1], b[1])]
        return ["", spots + a[1][both:] + b[1][both:], []]
    children, i, j = [], 0, 0
    for x, y, _ in [*_best_pairs(a[1], b[1]), (len(a[1]), len(b[1]), 0)]:
        children += a[1][i:x] + b[1][j:y]
        if x < len(a[1]):
            children.append(merge(a[1][x], b[1][y], same_page))
        i, j = x + 1, y + 1
    return [a[0], children, *([a[2] + b[2]] if len(a) > 2 else [])]


def shape_of(node: Element | Text) -> Shape:
    """Shape of a page's tree in which neighbours of one label, or repeated rows of up to ``PERIOD``
    labels, are folded into one."""
    if isinstance(node, Text):
        value = xxhash.xxh64_intdigest(block_text([node.value]).encode("utf-8", "surrogatepass")) >> 1
        return ["", [[value, value, 1]], [node.place]]
    children: list[Shape] = []
    for child in node.children:
        children.append(shape_of(child))
        for n in range(1, PERIOD + 1):
            if len(children) >= 2 * n and all(children[-k][0] == children[-k - n][0] for k in range(1, n + 1)):
                last = children[-n:]
                del children[-n:]
                children[-n:] = [merge(x, y, same_page=True) for x, y in zip(children[-n:], last, strict=True)]
                break
    return [node.label, children, *([1] if node.parent is None else [])]


def _bare(shape: Shape) -> Shape:
    """Without the places, to be handed on."""
    return ["", shape[1], []] if _is_text(shape) else [shape[0], [_bare(c) for c in shape[1]], *shape[2:]]


def fold(shapes: list[Shape]) -> Shape:
    out = shapes[0]
    for shape in shapes[1:]:
        out = merge(out, shape)
    return out


def _labels(shape: Shape):
    return "" if _is_text(shape) else [shape[0], [_labels(c) for c in shape[1]]]


def _needed(pages: int) -> int:
    """Pages of different content, of so many, in which a text must stand alike."""
    return max(2, pages) if pages < MIN_PAGES else max(MIN_PAGES, math.ceil(MIN_SHARE * pages))


def _constant(spot: list | int, needed: int) -> bool:
    return bool(spot) and spot[0] == spot[1] and spot[2] >= needed


def template_places(page: Shape, wrapper: Shape) -> set[int]:
    """Places of the page's texts that the wrapper holds constant."""
    needed = _needed(wrapper[2])
    found: set[int] = set()

    def walk(own: Shape, held: Shape) -> None:
        if _is_text(own):
            for mine, spot, place in zip(own[1], held[1], own[2]):
                if _constant(spot, needed) and mine[0] == spot[0]:
                    found.add(place)
            return
        for i, j, _ in _best_pairs(own[1], held[1]):
            walk(own[1][i], held[1][j])

    if page[0] == wrapper[0] and wrapper[2] > 1:
        walk(page, wrapper)
    return found


def _article(texts: list[Text]) -> list[Text]:
    """What the marks of boilerplate and article leave."""
    good = [t for t in texts if not t.boiler]
    rank = max((t.article for t in good if not t.blank), default=0)
    return [t for t in good if t.article >= rank]


def _content(texts: list[Text]) -> int:
    """Hash of the article's text; copies of one article are one page for the wrapper."""
    return xxhash.xxh64_intdigest(block_text([t.value + " " for t in _article(texts)]).encode("utf-8", "surrogatepass")) >> 1


def main_text(html: str | None, wrapper: Shape | None = None) -> str:
    """The text of the page's varying slots that belong to the article, blocks parted by two \\n.

    Without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
    comments, which are known by element, role, class and id. If a page has article elements, or
    else a main element, only what stands inside counts; otherwise blocks that are mostly links are
    left out.
    """
    root, texts = read(html)
    template = template_places(shape_of(root), wrapper) if wrapper else set()
    good = _article(texts)
    rank = max((t.article for t in good if not t.blank), default=0)
    held = sum(len(t.value) for t in good if t.place in template)
    rest = sum(len(t.value) for t in good if not t.blank) - held
    if wrapper and held > rest * (MOST_TEMPLATE if wrapper[2] >= MIN_PAGES else 1):
        template = set()
    blocks: list[list[Text]] = []
    for t in good:
        if blocks and blocks[-1][-1].block == t.block:
            blocks[-1].append(t)
        else:
            blocks.append([t])
    out = []
    for block in blocks:
        if all(t.blank or t.place in template for t in block):
            continue  # constant words inside a varying block belong to it
        text = block_text([t.value for t in block])
        linked = sum(len(t.value) for t in block if t.link)
        if text and (rank or 3 * linked < 2 * len(text)):
            out.append(text)
    return "\n\n".join(out)


def host_of(url: Column) -> Column:
    """Lower-cased host; pages without one are one host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def induce(pages: DataFrame) -> DataFrame:
    """host, wrapper: one tree per host, folded from the shapes of all its pages.

    Pages of one content count once, by the least of their shapes. Pages of one shape are summed
    up in the tasks. The shapes of a host are then folded in a tree
    of at most about ``FAN_IN`` shapes at a time, so the pages of a large host spread over tasks;
    folding takes shapes in the order of their text.
    """

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, contents, shapes = [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root, texts = read(html)
                hosts.append(host)
                contents.append(_content(texts))
                shapes.append(json.dumps(_bare(shape_of(root))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(shapes, pa.string())],
                names=["host", "content", "shape"],
            )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], Shape] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in seen], pa.string()), pa.array([json.dumps(s) for s in seen.values()], pa.string())],
                names=["host", "shape"],
            )
            seen.clear()
            return out

        for batch in batches:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shape = json.loads(text)
                key = (host, json.dumps(_labels(shape)))
                seen[key] = merge(seen[key], shape) if key in seen else shape
                if len(seen) >= GATHERED:
                    yield handed()
        if seen:
            yield handed()

    def folded(rows: pd.DataFrame) -> pd.DataFrame:
        shapes = [json.loads(s) for s in sorted(rows["shape"])]
        return pd.DataFrame({"host": rows["host"].iloc[:1], "shape": [json.dumps(fold(shapes))]})

    each = pages.select("host", "html").mapInArrow(shaped, "host string, content bigint, shape string")
    each = each.groupBy("host", "content").agg(F.min("shape").alias("shape")).select("host", "shape")
    level = written(each.mapInArrow(gather, "host string, shape string"), "shapes")
    while True:
        counts = written(level.groupBy("host").agg(F.count(F.lit(1)).alias("_n")), "shape-counts")
        most = counts.agg(F.max("_n")).first()[0] or 0
        if most <= 1:
            return level.select("host", F.col("shape").alias("wrapper"))
        nodes = F.ceil(F.col("_n") / FAN_IN)
        dealt = level.join(counts, "host").withColumn("_node", F.pmod(F.xxhash64("shape"), nodes))
        level = written(dealt.groupBy("host", "_node").applyInPandas(folded, "host string, shape string"), "shapes")
        if most <= FAN_IN and level.count() == counts.count():
            return level.select("host", F.col("shape").alias("wrapper"))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    The pages are read twice: for the wrappers and with them. Wrappers are broadcast if their
    written size is below ``BROADCAST_BYTES``, else pages and wrappers meet by host, where adaptive
    execution splits a host with very many pages. Null and empty pages have an empty text; a null
    url belongs to the host without a name; repeated rows are pages of their own; an empty table
    gives an empty result. Columns other than page_id, url and html are not read.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    wrappers = written(induce(rows), "wrappers")
    total = wrappers.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper"))).first()[0] or 0
    known = F.broadcast(wrappers) if total <= BROADCAST_BYTES else wrappers

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, Shape] = {}
        for batch in batches:
            out = []
            for html, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if wrapper is not None and wrapper not in parsed:
                    if len(parsed) >= 1_000:
                        parsed.clear()
                    parsed[wrapper] = json.loads(wrapper)
                out.append(main_text(html, parsed.get(wrapper)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    joined = rows.join(known, "host", "left").select("page_id", "url", "html", "wrapper")
    return joined.mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars bigint")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
