"""Main text of web pages, with a wrapper for each host.

A wrapper is a union-free regular expression over the layout of a host's pages: tags of blocks, fixed texts, text slots,
optional and repeated groups. All pages of a host are folded into it, pages of one shape first, then shape after shape, in
each task and then over tasks. Every page is matched against its host's wrapper: a text at a single place that counts over
all pages of the host confirm is the host's own, and so is a slot whose texts come again on other pages, as adverts and
footers do, or, for hosts with few pages, a text that many pages of the table have where such texts stand; a group that is
mostly links is a menu. What is left is the page's. Element kinds and the names of classes break ties: where there is an
article or main element its text is taken, unless more text stands outside; an element whose class or id is made up of
names of side matter counts less than its neighbours, and is taken only where nothing better is there.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterable
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, fresh, importable, slices
from tidemark.llm.url_templates import host_of

#: Items of a repeated unit at most.
MOST_UNIT = 12
#: Share of a host's different pages, and their number where it has so many, that must have a text at a single place to confirm it as the host's own.
LEAST_SHARE, LEAST_PAGES = 0.1, 3
#: Share of the texts of one path that must be so frequent; else it is a slot of the page's own texts, a title for one, of which some are equal.
LEAST_OF_PATH = 0.5
#: Different pages that a slot takes to be judged by its texts, and different pages of the table on which a text makes one of a slot's shared texts.
LEAST_DIFFERENT, LEAST_SHARED = 4, 3
#: Level of what is no main text by the kind of its element; each side matter by name adds one.
NEVER_MAIN = 1000
#: Long texts that tell whether two pages differ: most of them must.
TELLING = 3
#: Shapes of a host and hosts that a task holds before it folds or writes them.
HELD_SHAPES, HELD_HOSTS = 256, 2000

#: Hosts whose page counts are broadcast at most, of some 50 bytes each; beyond these the counts are joined by host.
MOST_BROADCAST_HOSTS = 500_000
#: Characters of all templates that are broadcast at most; beyond these the pages are shuffled.
MOST_TEMPLATE_CHARS = 16_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|[^<]+|<", re.S)
_RAW_END = {t: re.compile(rf"</{t}\s*(?:>|$)", re.I) for t in ("script", "style", "textarea", "noscript", "template", "iframe", "svg", "xmp")}
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

# Kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
NEVER = set("head nav header footer aside form script style noscript template iframe svg textarea button select option menu dialog object canvas audio video map".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
NOISE = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus dropdown footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags teaser teasers toolbar topbar widget widgets".split()
)
#: Words that say nothing in the name of a class; names of content.
NEUTRAL = set("area bar block bottom box center container group holder inner item left list outer page panel reader readers right row section site slot top unit user users wrap wrapper".split())
CONTENT = set("article body content entry main post story text".split())
MAIN = ("article", "main")
_CLOSES_P = BLOCK - {"body", "html", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "legend", "summary", "figcaption"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def tokens(page: str):
    """("start", tag, attributes), ("end", tag, ""), ("text", decoded text, ""). Scripts and their like give no text."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                yield "text", html.unescape(m[0]), ""
            elif m[0].startswith("<![CDATA["):
                yield "text", m[0][9:].removesuffix("]]>"), ""
            continue
        tag = tag.lower()
        if m[1]:
            yield "end", tag, ""
            continue
        yield "start", tag, m[3]
        if tag in _RAW_END and not m[3].endswith("/"):
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else n
            yield "end", tag, ""


def side_matter(name: str) -> bool:
    """Whether a class or id is made up of names of side matter and words that say nothing."""
    words = re.findall("[a-z]+", name)
    return any(w in NOISE for w in words) and all(w in NOISE or w in NEUTRAL for w in words)


def _noisy(tag: str, attributes: str) -> tuple[int, str]:
    """The level that an element adds to its texts, and its name within paths."""
    if tag in NEVER:
        return NEVER_MAIN, tag
    if not attributes.strip():
        return 0, tag
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    classes = found.get("class", "").split()
    names = [*classes, *found.get("id", "").split()]
    name = ".".join([tag, *classes[:1]])
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "") or found.get("role") in ROLES:
        return NEVER_MAIN, name
    return int(tag not in ("body", "html") and any(map(side_matter, names)) and CONTENT.isdisjoint(names)), name


def blocks(page: str) -> tuple[list[tuple[str, str, int, bool, bool]], bool]:
    """(path, text, level, in main, link) of each run of text that no block boundary splits, a link apart; and whether the page has an article or main element."""
    found, has_main, _ = layout(page)
    return found, has_main


def layout(page: str) -> tuple[list[tuple[str, str, int, bool, bool]], bool, list[tuple]]:
    """What blocks gives, and the tags of blocks, all closed, with ("text", [number of a run]) between them."""
    stack: list[tuple[str, str, int, bool]] = []  # tag, path, level, in main
    out: list[tuple[str, str, int, bool, bool]] = []
    items: list[tuple] = []
    buffer: list[tuple[str, bool]] = []
    state, has_main = ("", "", 0, False), False

    def flush() -> None:
        if buffer:
            text = " ".join("".join(x for x, _ in buffer).split())
            if text:
                links = sum(len(x) for x, link in buffer if link)
                items.append(("text", [len(out)]))
                out.append((state[1], text, state[2], state[3], 2 * links > len(text)))
            buffer.clear()

    def pop(k: int) -> None:
        nonlocal state
        items.extend(("tag", "/" + tag) for tag, *_ in reversed(stack[k:]) if tag in BLOCK)
        del stack[k:]
        state = stack[-1] if stack else ("", "", 0, False)

    links = 0
    for kind, what, attributes in tokens(page):
        if kind == "text":
            buffer.append((what, links > 0))
            continue
        if what in BLOCK:
            flush()
        if kind == "end":
            if what == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == what:
                    pop(k)
                    break
                if what not in BLOCK and stack[k][0] in BLOCK:
                    break
            continue
        if what == "br":
            buffer.append((" ", False))
        if what in VOID:
            continue
        if what in BLOCK or what in NEVER:
            links = 0
        if what in _CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if what in _SAME:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _SAME[what]:
                    pop(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if what == "a":
            links += 1
        noise, name = _noisy(what, attributes)
        main = what in MAIN and state[2] + noise < NEVER_MAIN
        has_main |= main
        if what in BLOCK or noise:
            if noise and what not in BLOCK:
                flush()
            state = (what, f"{state[1]}/{name}", state[2] + noise, state[3] or main)
        else:
            state = (what, *state[1:])
        if what in BLOCK:
            items.append(("tag", what))
        stack.append(state)
    flush()
    pop(0)
    return out, has_main, items


# wrappers: an expression is a list of items ("tag", name), ("text", fixed text or None), ("repeat", items) and ("optional", items)


def page_items(page: str) -> list[tuple]:
    """The layout of a whole page as items, repeated units folded."""
    found, _, items = layout(page)
    return fold([(kind, found[v[0]][1]) if kind == "text" else (kind, v) for kind, v in items])


def shape(item: tuple):
    """What two items must share to stand for each other; a text stands for any text."""
    kind, value = item
    return "" if kind == "text" else value if kind == "tag" else (kind, tuple(map(shape, value)))


def general(a: tuple, b: tuple) -> tuple:
    """The least expression for two items of one shape: texts that differ become a slot."""
    if a[0] == "text":
        return a if a == b else ("text", None)
    return a if a[0] == "tag" else (a[0], [general(x, y) for x, y in zip(a[1], b[1])])


def together(a: tuple, b: tuple) -> tuple:
    """As general, where the texts are lists of runs: both."""
    if a[0] == "text":
        return "text", a[1] + b[1]
    return a if a[0] == "tag" else (a[0], [together(x, y) for x, y in zip(a[1], b[1])])


def fold(items: list[tuple], join=general) -> list[tuple]:
    """Adjacent units of one shape become one repeated group, short units first."""
    shapes = [shape(x) for x in items]
    for size in range(1, MOST_UNIT + 1):
        if not any(a == b for a, b in zip(shapes, shapes[size:])):
            continue
        out, new, i = [], [], 0
        while i < len(items):
            n, first = 1, shapes[i]
            if i + size < len(items) and first == shapes[i + size] and not isinstance(first, tuple) and not (size == 1 and first == ""):
                unit = shapes[i : i + size]
                while shapes[i + n * size : i + (n + 1) * size] == unit:
                    n += 1
            if n > 1:
                body = items[i : i + size]
                for k in range(1, n):
                    body = [join(x, y) for x, y in zip(body, items[i + k * size : i + (k + 1) * size])]
                out.append(("repeat", body))
                new.append(("repeat", tuple(unit)))
                i += n * size
            else:
                out.append(items[i])
                new.append(first)
                i += 1
        items, shapes = out, new
    return items


def flat(wrapper: list[tuple]) -> list[tuple[tuple, bool]]:
    """(item, optional) without the optional groups."""
    return [p for x in wrapper for p in ([(y, True) for y in x[1]] if x[0] == "optional" else [(x, False)])]


def grouped(items: list[tuple[tuple, bool]], bodies: set[tuple]) -> list[tuple[tuple, bool]]:
    """Single copies of units that are repeated elsewhere become repeated groups too."""
    shapes = [shape(x) for x, _ in items]
    for body in sorted(bodies, key=lambda b: (-len(b), repr(b))):
        out, new, i, n = [], [], 0, len(body)
        while i < len(items):
            if shapes[i] == body[0] and tuple(shapes[i : i + n]) == body:
                part = items[i : i + n]
                out.append((("repeat", [x for x, _ in part]), any(o for _, o in part)))
                new.append(("repeat", body))
                i += n
            else:
                out.append(items[i])
                new.append(shapes[i])
                i += 1
        items, shapes = out, new
    return items


def bodies(items: list[tuple[tuple, bool]]) -> set[tuple]:
    return {shape(x)[1] for x, _ in items if x[0] == "repeat"}


def meet(a: list[tuple[tuple, bool]], b: list[tuple[tuple, bool]]) -> list[tuple[tuple, bool]]:
    out: list[tuple[tuple, bool]] = []
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, [shape(x) for x, _ in a], [shape(x) for x, _ in b], autojunk=False).get_opcodes():
        old, new = a[i1:i2], b[j1:j2]
        if tag == "equal":
            out += [(general(x, y), o or p) for (x, o), (y, p) in zip(old, new)]
            continue
        more, less = grouped(old, bodies(new)), grouped(new, bodies(old))
        if len(more) < len(old) or len(less) < len(new):
            out += meet(more, less)
        else:
            out += [(x, True) for x, _ in old + new]
    return out


def align(wrapper: list[tuple], page: list[tuple]) -> list[tuple]:
    """The expression that takes both, two wrappers or a wrapper and a page: equal shapes meet, one more copy joins its repeated group, the rest is optional."""
    out = meet(flat(wrapper), flat(page))
    made: list[tuple] = []
    for x, optional in out:
        if optional and made and made[-1][0] == "optional":
            made[-1][1].append(x)
        else:
            made.append(("optional", [x]) if optional else x)
    return made


def combined(parts: list[list[tuple]]) -> list[tuple]:
    """One expression for all, whatever their order."""
    parts = sorted(parts, key=lambda w: (-len(w), repr(w)))
    out = parts[0] if parts else []
    for w in parts[1:]:
        out = align(out, w)
    return out


def infer(pages: list[str]) -> list[tuple]:
    """The wrapper of a host's pages, equal pages once."""
    return combined([page_items(p) for p in dict.fromkeys(pages)])


def fixed_texts(wrapper: list[tuple]) -> list[str]:
    """Texts that every page must have where they stand; what is optional or repeated is the page's own."""
    return [v for k, v in wrapper if k == "text" and v is not None]


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def placed(run: tuple) -> int:
    """What stands for the text of a run at its path."""
    return text_hash(f"{run[0]}\0{run[1]}")


def runs_of(item: tuple) -> list[int]:
    """The runs of an item whose texts are lists of runs."""
    return list(item[1]) if item[0] == "text" else [] if item[0] == "tag" else [r for x in item[1] for r in runs_of(x)]


def best_level(found: list[tuple], runs: list[int]) -> list[int]:
    """The runs of the lowest level that there is below NEVER_MAIN."""
    least = min((found[r][2] for r in runs), default=NEVER_MAIN)
    return [r for r in runs if found[r][2] == least < NEVER_MAIN]


class Template:
    """A host's wrapper, the hashes of its confirmed texts, of its slots that hold texts of the host, and of shared texts at their paths."""

    def __init__(self, wrapper: list[tuple] = (), confirmed: Iterable[int] = (), slots: Iterable[int] = (), shared: Iterable[int] = ()):
        self.items, self.confirmed, self.slots, self.shared = flat(wrapper), frozenset(confirmed), frozenset(slots), frozenset(shared)
        self.shapes = [shape(x) for x, _ in self.items]
        self.known: dict[tuple, list[bool]] = {}

    def matched(self, shapes: tuple) -> list[bool]:
        """Which items of a page of these shapes have a place in the wrapper."""
        if shapes not in self.known:
            if len(self.known) > HELD_SHAPES:
                self.known.clear()
            hit = [False] * len(shapes)
            for _, j, n in SequenceMatcher(None, self.shapes, list(shapes), autojunk=False).get_matching_blocks():
                hit[j : j + n] = [True] * n
            self.known[shapes] = hit
        return self.known[shapes]

    def of_the_host(self, run: tuple) -> bool:
        """Whether the text of a run at a single place is no page's own. Within an article only a confirmed text is not."""
        t = placed(run)
        return t in self.confirmed or not run[3] and (t in self.shared or bool(self.slots) and text_hash(run[0]) in self.slots)

    def extract(self, page: str | None) -> str:
        """The main text: slots and groups of the wrapper, and what it has no place for, as the docstring of the module says."""
        found, has_main, items = layout(page or "")
        own = fold(items, together)
        keep: list[int] = []
        for item, hit in zip(own, self.matched(tuple(map(shape, own)))):
            runs = [r for r in runs_of(item) if found[r][2] < NEVER_MAIN]
            if item[0] == "text" and hit and runs and self.of_the_host(found[runs[0]]):
                continue
            outside = [r for r in runs if not found[r][3]]
            if 2 * sum(len(found[r][1]) for r in outside if found[r][4]) > sum(len(found[r][1]) for r in outside):
                runs = [r for r in runs if found[r][3]]
            keep += runs
        chosen = best_level(found, [r for r in keep if found[r][3] or not has_main])
        if has_main:
            outside = [r for r in keep if not found[r][3] and not found[r][2] and not found[r][4]]
            if sum(len(found[r][1]) for r in outside) > sum(len(found[r][1]) for r in chosen):
                chosen += outside
        return "\n".join(found[r][1] for r in sorted(chosen))


def extract(page: str | None) -> str:
    """The main text of a page whose host is not known."""
    return Template().extract(page)


def statistics(page: str, found: list[tuple], folded: list[tuple]) -> list[tuple[int, int, int, int]]:
    """(path, text of the path, k, telling) of the texts at single places of a page, and of 0 and 0, which stand for the page: the k-th of its long texts but that one."""
    hashes = [text_hash(run[1]) for run in found]
    longest = sorted({(-len(run[1]), h) for run, h in zip(found, hashes) if not run[2] and not run[4]})[: TELLING + 1]
    whole = text_hash(" ".join(map(str, hashes)))
    out = []
    for r in [None, *(x[1][0] for x in folded if x[0] == "text")]:
        path, t = (0, 0) if r is None else (text_hash(found[r][0]), placed(found[r]))
        telling = [h for _, h in longest if r is None or h != hashes[r]][:TELLING]
        out += [(path, t, k, telling[k] if k < len(telling) else whole) for k in range(TELLING)]
    return out


def wrappers(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, wrapper, confirmed, slots, shared): the expression of all pages of each host as JSON, and the hashes that its Template takes.

    A text is confirmed by the number of different pages that have it: for each of its pages, what other long texts stand
    there is counted by value, so that near copies count once. Hosts are folded in each task, so that a large one is dealt.
    """
    light = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html")).filter("html IS NOT NULL")
    names = ["host", "wrapper", "path", "t", "k", "telling"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def scan(batches):
        held: dict[str, dict[tuple, list[tuple]]] = {}

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names=names)

        def partial():
            return made([(h, json.dumps(combined(list(own.values())), ensure_ascii=False), None, None, None, None) for h, own in held.items()])

        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for h, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found, _, items = layout(p)
                    folded = fold(items, together)
                    rows += [(h, None, *x) for x in statistics(p, found, folded)]
                    own = held.setdefault(h, {})
                    texts = fold([(kind, found[v[0]][1]) if kind == "text" else (kind, v) for kind, v in items])
                    key = tuple(map(shape, texts))
                    own[key] = [general(x, y) for x, y in zip(own[key], texts)] if key in own else texts
                    if len(own) > HELD_SHAPES:
                        w = combined(list(own.values()))
                        held[h] = {tuple(map(shape, w)): w}
                yield made(rows)
                if len(held) > HELD_HOSTS:
                    yield partial()
                    held.clear()
        yield partial()

    rows = checkpointed(light.mapInArrow(scan, "host string, wrapper string, path bigint, t bigint, k int, telling bigint"))
    place = ["host", "path", "t"]
    counts = rows.filter("wrapper IS NULL").groupBy(*place, "k", "telling").agg(F.lit(1).alias("x")).groupBy(*place, "k").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(counts.groupBy(*place).agg(F.sort_array(F.collect_list("n"))[TELLING // 2].alias("n")))
    least = counts.filter("t = 0 AND n > 1").select("host", F.greatest(F.least(F.lit(LEAST_PAGES), "n"), F.ceil(F.col("n") * LEAST_SHARE)).alias("least"))
    texts = counts.filter("t <> 0")
    least = checkpointed(least)
    frequent = texts.join(F.broadcast(least) if least.count() <= MOST_BROADCAST_HOSTS else least, "host").withColumn("often", F.col("n") >= F.col("least"))
    own = frequent.groupBy("host", "path").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("often"), F.col("n"))).alias("sure"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("again"), F.collect_list(F.when(F.col("often"), F.col("t"))).alias("ts"))
    own = own.withColumns({"is_sure": F.col("sure") >= LEAST_OF_PATH * F.col("all"), "is_slot": (F.col("all") >= LEAST_DIFFERENT) & (F.col("again") >= LEAST_OF_PATH * F.col("all"))})
    sure = own.filter("is_sure OR is_slot").groupBy("host").agg(F.sort_array(F.flatten(F.collect_list(F.when(F.col("is_sure"), F.col("ts"))))).alias("confirmed"), F.sort_array(F.collect_list(F.when(F.col("is_slot"), F.col("path")))).alias("slots"))
    everywhere = texts.groupBy("path", "t").agg(F.sum("n").alias("n"))
    common = everywhere.groupBy("path").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("n") >= LEAST_SHARED, F.col("n"))).alias("again")).filter(F.col("again") >= LEAST_OF_PATH * F.col("all")).select("path")
    shared = texts.join(everywhere.filter(F.col("n") >= LEAST_SHARED).join(common, "path", "left_semi"), ["path", "t"], "left_semi").groupBy("host").agg(F.sort_array(F.collect_set("t")).alias("shared"))

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        w = combined([json.loads(x) for x in group["wrapper"]])
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(w, ensure_ascii=False)]})

    made = rows.filter("wrapper IS NOT NULL").groupBy("host").applyInPandas(merged, "host string, wrapper string")
    none = F.array().cast("array<bigint>")
    return made.join(sure, "host", "left").join(shared, "host", "left").select("host", "wrapper", *[F.coalesce(c, none).alias(c) for c in ("confirmed", "slots", "shared")])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id, url, text, n_chars. Blocks are joined by line feeds, white space within one is a space.

    A null page counts as empty; pages without a host share one wrapper, and a host with one page confirms no text. Rows that
    repeat, also under one id, and rows with a null id all stay, and equal pages of a host get equal texts; an empty table
    gives no rows.
    """
    importable(pages.sparkSession)
    host, page, template = fresh(pages, "__host"), fresh(pages, "__html"), fresh(pages, "__template")
    known = wrappers(pages, url_col, html_col).select(F.col("host").alias(host), F.to_json(F.struct("wrapper", "confirmed", "slots", "shared")).alias(template))
    rows = pages.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), host_of(F.col(f"`{url_col}`")).alias(host), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias(page))
    known = checkpointed(known)
    size = known.agg(F.sum(F.length(template) + F.length(host) + 64)).first()[0] or 0
    rows = rows.join(F.broadcast(known) if size <= MOST_TEMPLATE_CHARS else known, host, "left").select(id_col, url_col, template, page)

    def run(batches):
        templates: dict[str | None, Template] = {}
        for batch in batches:
            for part in slices(batch, 3):
                got = []
                for t, p in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if t not in templates:
                        if len(templates) > 1000:
                            templates.clear()
                        own = json.loads(t) if t else {"wrapper": "[]"}
                        templates[t] = Template(**own | {"wrapper": [tuple(x) for x in json.loads(own["wrapper"])]})
                    got.append(templates[t].extract(p))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    fields = [rows.schema[id_col], rows.schema[url_col]]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string, n_chars bigint"])
    return rows.mapInArrow(run, schema)


#: Character references that the SQL below decodes, of those with and without a semicolon the longer first.
REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&nbsp;": " ", "&middot;": "·", "&copy;": "©", "&quot": '"', "&amp;": "\x02", "&amp": "\x02", "\x02": "&"}


def article_sql() -> str:
    """The result in DuckDB's SQL for pages whose main text is the content of one article element without side matter."""
    decoded = "x"
    for name, value in REFERENCES.items():
        decoded = f"replace({decoded}, '{name}', '{value}')"
    blocks = "|".join(sorted(BLOCK))
    return rf"""
WITH a AS (SELECT page_id, url, regexp_extract(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?s)<article>(.*?)(?:</article>|$)', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '(?i)</?(?:{blocks})(?:\s[^>]*)?>', chr(1), 'g'), '(?i)<br\s*/?>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split({decoded}, chr(1)), lambda s: trim(regexp_replace(s, '[\s\x0b\x{{a0}}]+', ' ', 'g'))), lambda s: s <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t"""
