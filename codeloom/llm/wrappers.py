"""Main text of web pages, by wrappers inferred from all pages of a host."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections import Counter
from difflib import Match, SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_pieces, pieces, small_batches, tidy, tidy_group, written

#: Different pages from which a text that all of them have counts as constant.
SUPPORT = 3
#: Pairs of nodes from which the longest match is sought by rows of numbers, which is only faster.
ROWWISE = 20_000
#: Bytes of wrappers that a task holds before it hands them on.
HELD_BYTES = 32 << 20
#: Tokens of the longest group that is looked for as a repetition.
PERIOD = 12
#: Bytes of wrappers that are broadcast; more are joined by host.
BROADCAST_BYTES = 16 << 20

# The roles of elements, by name, by class or id, and by role attribute.
SKIP = {"nav", "footer", "aside", "form", "button", "select", "textarea", "dialog", "menu", "iframe", "svg", "object", "canvas", "head", "title"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTAINERS = {"article", "main", "section", "div", "td", "body"}
LABELS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|alert|newsletter|subscribe|share|sharing|social|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|respond|replies|disqus|related|popup|modal|overlay|widget|pagination|pager|toolbar|login|signup|search)(?:$|[\s_-])",
    re.I,
)
#: Elements that hold a text by themselves: one with a listed class stays wherever its text varies.
LEAVES = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "header"}
HEADINGS, LISTED = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"a", "li"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*|[^<>]*|(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>",
    re.S | re.I,
)
ATTR = re.compile(r"([a-zA-Z:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def tokens(page: str):
    """('<', name, label, skipped), ('/', name) and ('t', text) of a page; scripts, styles, titles and comments are left out.

    skipped is 1 by the element's name or attributes, 2 by a listed word in its class or id only, else 0.
    """
    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            yield "t", page[at : m.start()]
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            yield "/", name
            continue
        found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(m[4])} if m[4] else {}
        label = " ".join(x for x in (found.get("class"), found.get("id")) if x)
        hard = name in SKIP or found.get("role") in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in (found.get("style") or "").replace(" ", "")
        skipped = 1 if hard else 2 if label and LABELS.search(label) else 0
        yield "<", name, f"{name}.{found.get('class', '').split()[0]}" if found.get("class", "").strip() else name, skipped
    if at < len(page):
        tail = page[at:]
        cut = re.search(r"<[!/?a-zA-Z][^<>]*\Z", tail)  # a tag that the page's end cuts off
        if tail := tail[: cut.start()] if cut else tail:
            yield "t", tail


# A wrapper is a list of nodes: ("<", label, skipped), ("/", name), ("t", checksum or None for a
# slot, characters), ("rep", nodes), ("opt", nodes).


def shape(node) -> str:
    """What aligns: a tag with its like, a text with any text, a group with a group of its shape."""
    kind = node[0]
    return "t" if kind == "t" else f"{kind}{node[1]}" if kind in "</" else f"{kind}({' '.join(map(shape, node[1]))})"


def blend(a, b):
    """One node for two of a shape; texts that differ become a slot."""
    if a[0] == "t":
        return ("t", a[1] if a[1] == b[1] else None, a[2] + b[2])
    if a[0] in ("rep", "opt"):
        return (a[0], [blend(x, y) for x, y in zip(a[1], b[1], strict=True)])
    return a


def stream(page: str) -> list:
    out = []
    for t in tokens(page):
        if t[0] == "<":
            if t[1] not in VOID:
                out.append(("<", t[2], t[3]))
        elif t[0] == "/":
            out.append(("/", t[1]))
        elif s := " ".join(t[1].split()):
            if out and out[-1][0] == "t":
                out[-1] = ("t", zlib.crc32(s.encode("utf-8", "surrogatepass"), out[-1][1]), out[-1][2] + len(s))
            else:
                out.append(("t", zlib.crc32(s.encode("utf-8", "surrogatepass")), len(s)))
    return out


def fold(nodes: list) -> list:
    """Runs of groups of one shape become a repetition, shortest groups first."""
    for period in range(1, PERIOD + 1):
        shapes, out, i = [shape(n) for n in nodes], [], 0
        while i < len(nodes):
            j = i + period
            if shapes[i][0] == "<" and shapes[j - 1 : j] and shapes[j - 1][0] in "/r" and shapes[i:j] == shapes[j : j + period]:
                group = nodes[i:j]
                while shapes[i : i + period] == shapes[j : j + period]:
                    group = [blend(a, b) for a, b in zip(group, nodes[j : j + period], strict=True)]
                    j += period
                out.append(("rep", group))
                i = j
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def _as_groups(nodes: list, groups: list) -> list:
    """Single occurrences of the other stream's repeated groups become repetitions too."""
    present = {shape(n) for n in nodes}
    tried: dict[tuple, int] = {}  # the changes made when a group was last looked for
    changes = 0
    for want in (tuple(map(shape, g)) for g in groups):
        if tried.get(want) == changes or not present.issuperset(want):
            continue
        out, i, shapes = [], 0, tuple(shape(n) for n in nodes)
        while i < len(nodes):
            if shapes[i] == want[0] and shapes[i : i + len(want)] == want:
                out.append(("rep", nodes[i : i + len(want)]))
                i += len(want)
                changes += 1
            else:
                out.append(nodes[i])
                i += 1
        nodes, tried[want] = out, changes
        present.add(f"rep({' '.join(want)})")
    return nodes


class Matcher(SequenceMatcher):
    """A SequenceMatcher without junk whose longest match of two long runs is found a row at a time; the matches are the same."""

    def __init__(self, a: list[str], b: list[str]):
        super().__init__(None, a, b, autojunk=False)
        codes = {x: i for i, x in enumerate(dict.fromkeys([*a, *b]))}
        self.x, self.y = (np.array([codes[v] for v in side], np.int64) for side in (a, b))

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None):
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        if (ahi - alo) * (bhi - blo) < ROWWISE:
            return super().find_longest_match(alo, ahi, blo, bhi)
        y, best = self.y[blo:bhi], (alo, blo, 0)
        places = {}  # of each shape in y, from the left
        before = np.zeros(len(y) + 1, np.int64)  # lengths of the matches that end in the row above
        last = np.zeros(0, np.int64)
        for i in range(alo, ahi):
            at = places.get(self.x[i])
            if at is None:
                at = places[self.x[i]] = np.flatnonzero(y == self.x[i])
            k = before[at] + 1
            before[last] = 0
            last = at + 1
            before[last] = k
            if len(k) and k.max() > best[2]:
                j = int(k.argmax())
                n = int(k[j])
                best = (i - n + 1, blo + int(at[j]) - n + 1, n)
        return Match(*best)


def align(wrapper: list, page: list) -> list:
    """The wrapper made to cover a page too: text mismatches become slots, tag mismatches repetitions or optional groups."""
    page = _as_groups(page, [n[1] for n in wrapper if n[0] == "rep"])
    wrapper = _as_groups(wrapper, [n[1] for n in page if n[0] == "rep"])
    flat, back = [], []  # optional groups are entered, so that a page that has one meets it
    for n in wrapper:
        inner = n[1] if n[0] == "opt" else [n]
        flat += inner
        back += [n[0] == "opt"] * len(inner)
    out = []

    def optional(nodes):
        if nodes:
            out.append(("opt", nodes))

    for op, i, j, k, m in Matcher([shape(n) for n in flat], [shape(n) for n in page]).get_opcodes():
        if op == "equal":
            for x, y, was in zip(flat[i:j], page[k:m], back[i:j], strict=True):
                b = blend(x, y)
                out.append(("opt", [b]) if was else b)
        else:
            optional(flat[i:j])
            optional(page[k:m])
    return out


def infer(streams: list[list]) -> list:
    """The wrapper of some pages' folded streams, aligned one after the other."""
    wrapper = streams[0]
    for s in streams[1:]:
        wrapper = align(wrapper, s)
    return wrapper


def container(wrapper: list, pages: int) -> str | None:
    """The label of the element that holds the article: of the text in slots outside skipped elements, an article or main
    with at least half, else the innermost container with at least 70 %."""
    weight: Counter = Counter()
    depth: dict[str, int] = {}
    stack: list[tuple[str, bool]] = []
    total = 0

    def walk(nodes):
        nonlocal total
        for n in nodes:
            if n[0] == "<":
                stack.append((n[1], n[2] or (n[1].split(".")[0] == "header" and not any(s.split(".")[0] == "article" for s, _ in stack))))
            elif n[0] == "/":
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0].split(".")[0] == n[1]:
                        del stack[i:]
                        break
            elif n[0] == "t":
                if (n[1] is None or pages == 1) and not any(skip for _, skip in stack):
                    total += n[2]
                    for i, s in enumerate(dict.fromkeys(s for s, _ in stack)):
                        weight[s] += n[2]
                        depth[s] = max(depth.get(s, 0), i)
            else:
                walk(n[1])

    walk(wrapper)
    for name in ("article", "main"):
        some = [s for s in weight if s.split(".")[0] == name and weight[s] >= 0.5 * total]
        if some:
            return max(some, key=lambda s: (weight[s], s))
    some = [s for s in weight if s.split(".")[0] in CONTAINERS and weight[s] >= 0.7 * total]
    return max(some, key=lambda s: (depth[s], s)) if some else None


def verdicts(wrapper: list, label: str | None, pages: int) -> tuple[list[str], list[str]]:
    """What a wrapper of so many different pages says of the blocks in its container: constant texts, which go, and listed elements that stay.

    A text is constant if it is the same on all pages, outside repetitions and optional groups. A
    constant heading stays if the text behind it varies and isn't a link's or a list's. An
    element with a listed word stays if its text varies and isn't a list of its own: on all pages,
    or, for LEAVES, also in optional or repeated groups. On others the list decides.
    """
    drop: set[str] = set()
    votes: dict[str, list[bool]] = {}
    stack: list[dict] = []

    def close(e):
        if e["soft"]:
            votes.setdefault(e["label"], []).append(e["slot"] and not e["list"] and (e["always"] or e["label"].split(".")[0] in LEAVES))

    heading = None  # a constant one whose fate the next text decides

    def walk(nodes, reps, opts):
        nonlocal heading
        for n in nodes:
            if n[0] == "<":
                stack.append({"label": n[1], "soft": n[2] == 2 or n[1].split(".")[0] == "header", "slot": False, "list": False, "reps": reps, "always": not reps and not opts})
            elif n[0] == "/":
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i]["label"].split(".")[0] == n[1]:
                        for e in stack[i:]:
                            close(e)
                        del stack[i:]
                        break
            elif n[0] == "t":
                for e in stack:
                    e["list"] |= reps > e["reps"]
                    e["slot"] |= n[1] is None
                names = [e["label"].split(".")[0] for e in stack]
                if heading and n[1] is None and not LISTED & set(names):
                    heading = None
                if heading:
                    drop.add(heading)
                    heading = None
                if n[1] is not None and not reps and not opts and pages >= SUPPORT and (label is None or any(e["label"] == label for e in stack)):
                    found = constant(stack[-1]["label"] if stack else "", n[1])
                    if HEADINGS & set(names):
                        heading = found
                    else:
                        drop.add(found)
            else:
                walk(n[1], reps + (n[0] == "rep"), opts + (n[0] == "opt"))

    walk(wrapper, 0, 0)
    if heading:
        drop.add(heading)
    for e in stack:
        close(e)
    return sorted(drop), sorted(k for k, v in votes.items() if all(v))


def constant(label: str, checksum: int) -> str:
    return f"{label}|{checksum}"


def article(page: str, label: str | None, drop=frozenset(), keep=frozenset()) -> str | None:
    """Blocks of the elements with a label, without skipped elements but those to keep, and without blocks of constant texts; None if the page has no such element. Without a label, of the body."""
    blocks, words, found = [], [], False
    inside = skip = 0  # open elements of the container's name, of the skipped element's name
    skipping = ""
    name = label.split(".")[0] if label else ""
    stack: list[str] = []  # labels of the open elements
    checksum = None  # of the text since the last tag, as in stream()
    varies = False

    def text_ends():
        nonlocal checksum, varies
        if checksum is not None and constant(stack[-1] if stack else "", checksum) not in drop:
            varies = True
        checksum = None

    def end():
        nonlocal varies
        text_ends()
        if (s := " ".join(entities.unescape("".join(words)).split())) and varies:
            blocks.append(s)
        words.clear()
        varies = False

    for t in tokens(page):
        if t[0] == "t":
            if not skip and (inside or not label):
                words.append(t[1])
                if s := " ".join(t[1].split()):
                    checksum = zlib.crc32(s.encode("utf-8", "surrogatepass"), checksum or 0)
            continue
        tag = t[1]
        if tag in BLOCKS:
            end()
        elif tag == "br":
            words.append(" ")
        if tag not in VOID:
            text_ends()
        if t[0] == "<":
            if tag in VOID:
                continue
            stack.append(t[2])
            if skip:
                skip += tag == skipping
            elif ((t[3] and t[2] != label) or (tag == "header" and not (inside and name == "article"))) and (t[3] == 1 or t[2] not in keep):
                skip, skipping = 1, tag
            elif inside:
                inside += tag == name
            elif t[2] == label:
                inside, found = 1, True
            continue
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].split(".")[0] == tag:
                del stack[i:]
                break
        if skip:
            if tag == skipping:
                skip -= 1
            elif inside == 1 and tag == name:  # a skipped element that isn't closed ends with the container
                skip = inside = 0
        elif inside and tag == name:
            inside -= 1
    end()
    return "\n".join(blocks) if found or not label else None


def extract(page: str, label: str | None, drop=frozenset(), keep=frozenset()) -> str:
    """A page's text by its wrapper's container and verdicts, or, if it has no element of that label, by its own."""
    out = article(page, label, drop, keep) if label else None
    if out is None:
        own = container(fold(stream(page)), 1)
        out = article(page, own, drop, keep)
    return out or ""


def host(url: str):
    """The host of a url in lower case, without its port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def shape_key(nodes: list) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(map(shape, nodes)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _texts(nodes: list) -> str:
    return " ".join(_texts(n[1]) if n[0] in ("rep", "opt") else str(n[1]) for n in nodes if n[0] not in "</")


def merged(a: tuple[list, list], b: tuple[list, list]) -> tuple[list, list]:
    """(nodes, checksums of different pages, SUPPORT of them at most) of pages of one shape, put together."""
    return [blend(x, y) for x, y in zip(a[0], b[0], strict=True)], sorted({*a[1], *b[1]})[:SUPPORT]


def templates(shapes: dict[int, tuple[list, list]]) -> dict[int, tuple[str | None, list[str], list[str]]]:
    """Container, constant texts and kept elements for each shape of a host's pages.

    A shape's own container says which template it is of; the shapes of a template are aligned to
    one wrapper, which then decides.
    """
    groups: dict[str | None, list[int]] = {}
    for k in sorted(shapes):
        nodes, different = shapes[k]
        own = container(nodes, len(different)) if len(different) >= SUPPORT else None
        groups.setdefault(own or container(nodes, 1), []).append(k)
    out = {}
    for label, keys in groups.items():
        wrapper = infer([shapes[k][0] for k in keys])
        different = sorted({x for k in keys for x in shapes[k][1]})[:SUPPORT]
        found = container(wrapper, len(different)) if len(different) >= SUPPORT else None
        use = found if found and all(f"<{found}" in _labels(shapes[k][0]) for k in keys) else label
        out |= dict.fromkeys(keys, (use, *verdicts(wrapper, use, len(different))))
    return out


def _labels(nodes: list) -> set[str]:
    return {x for n in nodes for x in (_labels(n[1]) if n[0] in ("rep", "opt") else [f"<{n[1]}"] if n[0] == "<" else [])}


def wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host, shape, container (label or null), drop and keep of each host and shape of its pages.

    Each task folds its pages and blends those of one host and shape; a second step blends these
    and aligns a host's shapes. So every page counts, and a host with most pages sends its
    shapes for each task.
    """
    small_batches(pages.sparkSession)
    base = pages.select(host(url).alias("host"), page)

    def blended(batches):
        held: dict[tuple[str, int], tuple[list, list]] = {}
        size = 0

        def flush():
            rows = [(h, k, zlib.compress(json.dumps(x).encode(), 1)) for (h, k), x in held.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["host", "shape", "wrapper"])

        for batch in batches:
            for piece in pieces(batch, page):
                for h, text in zip(piece.column("host").to_pylist(), piece.column(page).to_pylist(), strict=True):
                    nodes = fold(stream(text or ""))
                    key = (h, shape_key(nodes))
                    mine = (nodes, [zlib.crc32(_texts(nodes).encode())])
                    if key in held:
                        held[key] = merged(held[key], mine)
                    else:
                        held[key] = mine
                        size += 200 * (len(nodes) + 1)
                if size > HELD_BYTES:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    def align_host(t: pa.Table) -> pa.Table:
        shapes: dict[int, tuple[list, list]] = {}
        for k, packed in sorted(zip(t.column("shape").to_pylist(), t.column("wrapper").to_pylist(), strict=True)):
            nodes, different = json.loads(zlib.decompress(packed))
            mine = (_thaw(nodes), different)
            shapes[k] = merged(shapes[k], mine) if k in shapes else mine
        rules = templates(shapes)
        texts = pa.list_(pa.string())
        columns = [pa.array([x[i] for x in rules.values()], kind) for i, kind in enumerate((pa.string(), texts, texts))]
        return pa.table([pa.array([t.column("host")[0].as_py()] * len(rules), pa.string()), pa.array(list(rules), pa.int64()), *columns], names=["host", "shape", "container", "drop", "keep"])

    return base.mapInArrow(tidy(blended), "host string, shape long, wrapper binary").groupBy("host").applyInArrow(tidy_group(align_host), "host string, shape long, container string, drop array<string>, keep array<string>")


def _thaw(nodes: list) -> list:
    return [(n[0], _thaw(n[1])) if n[0] in ("rep", "opt") else tuple(n) for n in nodes]


def extract_pages(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """pages (all columns) and the main text; a column of that name is replaced.

    Wrappers are a short row for each host and shape of page. While all of them take at most
    BROADCAST_BYTES they are broadcast and no page is shuffled; beyond, pages are joined to them
    by host and shape (AQE splits those with very many pages).

    Defined cases: a null or empty page has an empty text; a page without a usable url belongs
    to the host ''; with fewer than SUPPORT different pages of a template no text is constant,
    and the list of words decides; elements hidden or named in SKIP are always left out;
    unclosed and cut-off tags are borne, and a tag whose quote isn't closed ends at its '>'; very
    long pages count whole; repeated rows have equal texts; an empty table gives an empty one; all
    columns but `out` stay, whatever their names.
    """
    found = written(wrappers(pages, url, page), "wrappers")
    size = found.agg(F.sum(F.octet_length("host") + F.coalesce(F.octet_length("container"), F.lit(0)) + F.octet_length(F.concat_ws(",", "drop", "keep")) + 64)).first()[0] or 0
    given = [c for c in pages.columns if c != out]
    names = [f"c{i}" for i in range(len(given))]
    place = names[given.index(page)]
    base = pages.select(*(F.col(f"`{g}`").alias(c) for c, g in zip(names, given, strict=True)), host(url).alias("host"))
    columns, listed = base.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema)

    def shaped(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [shape_key(fold(stream(p or ""))) for p in batch.column(place).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*columns, "shape"])

    keyed = map_pieces(base, place, shaped, f"{listed}, shape long")
    joined = keyed.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, ["host", "shape"], "left")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rules = zip(*(batch.column(c).to_pylist() for c in (place, "container", "drop", "keep")), strict=True)
        text = [extract(p or "", c, frozenset(d or ()), frozenset(k or ())) for p, c, d, k in rules]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(text, pa.string())], names=[*names, "text"])

    done = map_pieces(joined.select(*names, "container", "drop", "keep"), place, fn, ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in names) + ", text string")
    return done.select(*(F.col(c).alias(g) for c, g in zip(names, given, strict=True)), F.col("text").alias(out))


def page_report(pages: DataFrame) -> DataFrame:
    """Per page page_id, url, text, n_chars."""
    return extract_pages(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
