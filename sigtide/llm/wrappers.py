"""Main text of web pages by wrappers: union-free expressions inferred per host.

Every page becomes a stream of tokens (``htmltokens``). Streams of one host are aligned one after
the other: tokens that agree are matched, texts that differ become slots, and a mismatch is a further
turn of the group before it (repeated) or else a group one side lacks (optional). The result accepts
all its pages and counts, per slot, pages, blocks, characters, linked characters, and whether the
text is ever another one. Main slots are then chosen on the wrapper: inside its article or main
element, else in the container where most of the unlinked text that changes from page to page stands,
without parts named or marked as menus, notices, adverts, forms or comments.

Tasks fold equal streams first. Alignment goes on in rounds of groups of about ``GROUP`` wrappers of
one host with like layouts, so a host with a third of all pages is many tasks, and one with many
layouts keeps several wrappers. Wrappers hold structure, no text. Only the slots a page's blocks
belong to are joined back, by host and stream.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sigtide.llm.arrow import map_arrow
from sigtide.llm.htmltokens import CLOSE, OPEN, TEXT, Page, Token, digest
from sigtide.llm.urls import host_of
from sigtide.session import materialised

GROUP = 32
ALIKE = 0.5  # share of the smaller wrapper's tokens that two of one layout have in common
MAX_TOKENS = 20_000  # larger wrappers are not aligned any further
HELD = 2_000  # streams a task holds before it hands them on
SEEDS = 4
TEMPLATE_PAGES = 3  # pages with one and the same text that make a slot part of the template

# fixed values: elements and roles outside the main text, and words in their ids and classes
DROPPED = frozenset(
    "head nav footer aside form button select textarea dialog noscript template iframe object svg canvas "
    "audio video map fieldset legend label script style title menu".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar "
    "toolbar".split())
NAMES = re.compile(
    r"nav|navs|navbar\w*|navigation|menu|menus|submenu|breadcrumbs?|topbar|footer\w*|sidebar\w*|ad|ads|adv|"
    r"advert\w*|adsense|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popups?|"
    r"modal|overlay|newsletters?|subscribe\w*|subscription|signup|login|share|sharing|social|related|"
    r"recommend\w*|paginat\w*|pager|toolbar|widgets?|copyright|skip|forms?")
COMMENTS = re.compile(r"comments?|comment(?:ers?|list|form|section|thread|box|body|area)|disqus|repl(?:y|ies)|respond")
HEADERS = re.compile(r"header|masthead")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li td th tr dt dd pre blockquote ul ol dl table tbody figure".split())

_KEY = re.compile(r"([a-z0-9:_-]+)(!?)(.*)", re.S)
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


# ---- what an element's name says -------------------------------------------------------------------

@lru_cache(1 << 14)
def reason(key: str) -> str:
    """Why an element is outside the main text: dropped, named, comments, header, or empty."""
    tag, hidden, rest = _KEY.match(key).groups() if _KEY.match(key) else (key, "", "")
    roles = set(re.findall(r"@([^@#.]+)", rest))
    if tag in DROPPED or hidden or roles & ROLES:
        return "dropped"
    words = [w.lower() for name in re.findall(r"[#.]([^@#.]+)", rest) for w in _WORD.findall(name)]
    if any(COMMENTS.fullmatch(w) for w in words):
        return "comments"
    if any(NAMES.fullmatch(w) for w in words):
        return "named"
    if tag == "header" or any(HEADERS.fullmatch(w) for w in words):
        return "header"
    return ""


def tag_of(key: str) -> str:
    return re.match(r"[^!@#.]*", key)[0]


def is_article(key: str) -> bool:
    return tag_of(key) == "article" or "@article" in key


def is_main(key: str) -> bool:
    return tag_of(key) == "main" or "@main" in key


# ---- wrappers --------------------------------------------------------------------------------------

class Wrapper:
    """Tokens in order, the paths they name, and how many pages they accept."""

    def __init__(self, tokens: list[Token], paths: dict[int, tuple[int, str]], pages: int) -> None:
        self.tokens, self.paths, self.pages = tokens, paths, pages

    @property
    def slots(self) -> list[Token]:
        return [t for t in self.tokens if t.kind == TEXT]

    @property
    def shape(self) -> int:
        return digest(*(f"{t.name}{'+' if t.rep else ''}" for t in self.tokens))

    def names(self) -> set[int]:
        return {t.name for t in self.tokens}

    def dump(self) -> str:
        return json.dumps([self.pages, [[p, *v] for p, v in self.paths.items()], [
            [t.kind, t.path, t.rep, t.opt] + ([t.pages, t.n, t.chars, t.link, t.const] if t.kind == TEXT else [])
            for t in self.tokens]], separators=(",", ":"))

    @staticmethod
    def load(text: str) -> Wrapper:
        pages, paths, tokens = json.loads(text)
        return Wrapper([Token(*t) for t in tokens], {p: (up, key) for p, up, key in paths}, pages)


def _run(tokens: list[Token], at: int) -> int:
    """End of the element or text that begins at ``at``; 0 if it does not close."""
    if tokens[at].kind == TEXT:
        return at + 1
    depth = 0
    for k in range(at, len(tokens)):
        if tokens[k].path == tokens[at].path:
            depth += (tokens[k].kind == OPEN) - (tokens[k].kind == CLOSE)
            if not depth:
                return k + 1
    return 0


def _run_before(tokens: list[Token], token: Token) -> int | None:
    """Start of the element or text right before the end of ``tokens`` that a repeat of would begin
    with ``token``."""
    if not tokens or tokens[-1].path != token.path:
        return None
    if token.kind == TEXT:
        return len(tokens) - 1 if tokens[-1].kind == TEXT else None
    if token.kind != OPEN or tokens[-1].kind != CLOSE:
        return None
    depth = 0
    for k in range(len(tokens) - 1, -1, -1):
        if tokens[k].path == token.path:
            depth += (tokens[k].kind == CLOSE) - (tokens[k].kind == OPEN)
            if not depth:
                return k
    return None


class _Places:
    """Next place of a token name, for places that only move forward."""

    def __init__(self, tokens: list[Token]) -> None:
        self.at: dict[int, list[int]] = {}
        for k in range(len(tokens) - 1, -1, -1):
            self.at.setdefault(tokens[k].name, []).append(k)

    def after(self, name: int, k: int) -> int | None:
        places = self.at.get(name)
        while places and places[-1] < k:
            places.pop()
        return places[-1] if places else None


def align(a: list[Token], b: list[Token], same_page: bool = False) -> list[Token]:
    """One stream for both: matched, repeated and optional tokens in order. Every token of ``a`` and
    ``b`` is in it or absorbed by one that is."""
    out: list[Token] = []
    places = (_Places(a), _Places(b))
    sides = (a, b)
    at = [0, 0]

    def optional(side: int, stop: int) -> None:
        for t in sides[side][at[side]:stop]:
            t.opt = 1
            out.append(t)
        at[side] = stop

    def repeated(side: int) -> bool:
        tokens, k = sides[side], at[side]
        start = _run_before(out, tokens[k])
        stop = 0 if start is None else _run(tokens, k)
        if not stop:
            return False
        again = tokens[k:stop]
        if [t.name for t in again] == [t.name for t in out[start:]]:
            for x, y in zip(out[start:], again, strict=True):
                x.absorb(y, same_page=True)
        else:
            # another form of the same element: what differs inside is optional
            out[start:] = [out[start], *align(out[start + 1:-1], again[1:-1], True), out[-1]]
            again[0].alias, again[-1].alias = out[start], out[-1]
        for t in out[start:]:
            t.rep = 1
        at[side] = stop
        return True

    while at[0] < len(a) and at[1] < len(b):
        x, y = a[at[0]], b[at[1]]
        if x.name == y.name:
            x.absorb(y, same_page)
            out.append(x)
            at = [at[0] + 1, at[1] + 1]
        elif not (repeated(1) or repeated(0)):
            in_a, in_b = places[0].after(y.name, at[0]), places[1].after(x.name, at[1])
            if in_a is not None and (in_b is None or in_a - at[0] <= in_b - at[1]):
                optional(0, in_a)
            elif in_b is not None:
                optional(1, in_b)
            else:
                optional(0, at[0] + 1)
                optional(1, at[1] + 1)
    for side in (0, 1):
        while at[side] < len(sides[side]):
            if not repeated(side):
                optional(side, at[side] + 1)
    return out


def merge(into: Wrapper, other: Wrapper) -> Wrapper:
    return Wrapper(align(into.tokens, other.tokens), into.paths | other.paths, into.pages + other.pages)


def alike(a: set[int], b: set[int]) -> bool:
    return len(a & b) >= ALIKE * min(len(a), len(b))


def layout(names: set[int]) -> list[int]:
    """Smallest hash of a token name under each seed: like sets of names often share one."""
    return [min((digest(seed, n) for n in names), default=0) for seed in range(SEEDS)]


# ---- main slots ------------------------------------------------------------------------------------

class _Element:
    def __init__(self, key: str, up: _Element | None, rep: int) -> None:
        self.key, self.up, self.rep = key, up, rep
        self.reason = reason(key)
        self.mass = 0
        self.inside: list[_Element] = []
        if up:
            up.inside.append(self)

    def above(self) -> Iterator[_Element]:
        at: _Element | None = self
        while at:
            yield at
            at = at.up

    def has(self, other: _Element) -> bool:
        return any(x is self for x in other.above())


def main_slots(wrapper: Wrapper) -> list[bool]:
    """Which text slots of the wrapper, in order, are main text."""
    root = _Element("", None, 0)
    now: dict[int, _Element] = {0: root}
    of: list[_Element] = []
    elements = [root]
    for t in wrapper.tokens:
        if t.kind == OPEN:
            up, key = wrapper.paths[t.path]
            now[t.path] = _Element(key, now.get(up, root), t.rep)
            elements.append(now[t.path])
        elif t.kind == TEXT:
            of.append(now.get(t.path, root))
    slots = wrapper.slots
    # text all pages share is the template's, where other text changes
    fixed = [t.const is not None and t.pages >= TEMPLATE_PAGES and not t.rep for t in slots]
    mass = [0 if fixed[k] else max(0, t.chars - 2 * t.link) for k, t in enumerate(slots)]
    if not any(mass):
        fixed, mass = [False] * len(slots), [max(0, t.chars - 2 * t.link) for t in slots]
    for k, e in enumerate(of):
        for x in e.above():
            x.mass += mass[k]

    # an element that holds the whole article is no menu, whatever it is called
    cores = [e for e in elements if (is_article(e.key) or is_main(e.key)) and not any(
        x.reason == "comments" for x in e.above())]
    titles = [e for e in elements if tag_of(e.key) == "h1"]
    for e in elements:
        if not e.reason:
            continue
        if cores:
            rescued = e not in cores and e.reason != "comments" and all(e.has(c) for c in cores)
        else:
            rescued = (tag_of(e.key) not in ("nav", "footer", "head") and "!" not in e.key
                       and 2 * e.mass > root.mass and e.reason != "comments"
                       and (not titles or all(e.has(c) for c in titles)))
        if rescued or (e in cores and e.reason in ("named", "header")):
            e.reason = ""

    def outside(e: _Element) -> bool:
        chain = list(e.above())
        in_heading = any(tag_of(x.key) in HEADINGS for x in chain)
        for k, x in enumerate(chain):
            if x.reason == "header":
                # the title of an article may stand in its own header
                if in_heading and any(is_article(y.key) or is_main(y.key) for y in chain[k + 1:]):
                    continue
                return True
            if x.reason:
                return True
        return False

    out = [outside(e) for e in of]
    region = [e for e in elements if is_article(e.key) and not outside(e)]
    region = [e for e in region if not any(x in region for x in e.above() if x is not e)]
    titled = [e for e in region if any(e.has(t) for t in titles)]
    region = titled or region or [e for e in elements if is_main(e.key) and not outside(e)]
    if region:
        return [not out[k] and any(r.has(e) for r in region) for k, e in enumerate(of)]

    # nothing is marked as the article: go down while one part has most of the text
    for e in elements:
        e.mass = 0
    for k, e in enumerate(of):
        for x in e.above():
            x.mass += 0 if out[k] else mass[k]
    at = root
    while True:
        best = max(at.inside, key=lambda e: e.mass, default=None)
        if best is None or not best.mass or 5 * best.mass < 3 * at.mass or tag_of(best.key) in LEAVES or best.rep:
            break
        at = best
    return [not out[k] and not fixed[k] and (at.has(e) or any(tag_of(x.key) == "h1" for x in e.above()))
            and (5 * t.link < 3 * t.chars or any(tag_of(x.key) in HEADINGS for x in e.above()))
            for k, (e, t) in enumerate(zip(of, slots, strict=True))]


# ---- Spark -----------------------------------------------------------------------------------------

_BLOCKS = "array<struct<slot:int,text:string>>"
_WRAPPER = "id long, layout array<bigint>, wrapper string"


def _mute(key: str) -> bool:
    return reason(key) in ("dropped", "named", "comments")


def read_pages(pages: DataFrame, html: str, url: str) -> tuple[DataFrame, DataFrame]:
    """(pages, streams) of one pass, written below ``spark.checkpoint.dir``.

    ``pages`` are (page, host, shape, blocks): the other columns in a struct, and the text blocks with
    the slot of the page's stream they stand in. ``streams`` are (host, shape, id, layout, wrapper): per
    task, the streams of a host with their counts.
    """
    kept = StructType([f for f in pages.schema.fields if f.name != html])
    names = kept.names
    schema = StructType([StructField("page", kept), *StructType.fromDDL(
        f"host string, shape long, blocks {_BLOCKS}, {_WRAPPER}").fields])
    block_type = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        held: dict[tuple[str, int], Wrapper] = {}
        handed = 0

        def streams(page_type: pa.DataType) -> pa.RecordBatch:
            nonlocal handed
            ids = range(handed, handed + len(held))
            handed += len(held)
            batch = pa.RecordBatch.from_arrays([
                pa.nulls(len(held), page_type), pa.array([h for h, _ in held], pa.string()),
                pa.array([s for _, s in held], pa.int64()), pa.nulls(len(held), block_type),
                pa.array([part << 32 | i for i in ids], pa.int64()),
                pa.array([layout(w.names()) for w in held.values()], pa.list_(pa.int64())),
                pa.array([w.dump() for w in held.values()], pa.string())], schema.names)
            held.clear()
            return batch

        page_type = None
        for batch in batches:
            columns = [c for c in names if c != "_host"]
            page_type = pa.struct([pa.field(c, batch.schema.field(c).type) for c in columns])
            texts, hosts = batch.column(html).to_pylist(), batch.column("_host").to_pylist()
            shapes, blocks = [], []
            for text, host in zip(texts, hosts, strict=True):
                page = Page(text or "", _mute)
                own = Wrapper(page.tokens, page.paths, 1)
                slot = {id(t): k for k, t in enumerate(own.slots)}
                shapes.append(own.shape)
                blocks.append([{"slot": slot[id(t.found())], "text": x} for t, x in page.blocks
                               if id(t.found()) in slot])
                old = held.get((host, shapes[-1]))
                if old is None:
                    used = {t.path for t in own.tokens}
                    own.paths = {p: v for p, v in own.paths.items() if p in used}
                    held[host, shapes[-1]] = own
                else:
                    old.pages += 1
                    for x, y in zip(old.tokens, own.tokens, strict=True):
                        x.absorb(y, same_page=False)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.StructArray.from_arrays([batch.column(c) for c in columns], fields=list(page_type)),
                batch.column("_host"), pa.array(shapes, pa.int64()), pa.array(blocks, block_type),
                pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.string())],
                schema.names)
            if len(held) > HELD:
                yield streams(page_type)
        if held:
            yield streams(page_type)

    both = materialised(map_arrow(pages.withColumn("_host", host_of(F.col(url))), task, schema), "pages")
    return (both.where("blocks is not null").select("page", "host", "shape", "blocks"),
            both.where("id is not null").select("host", "shape", "id", "layout", "wrapper"))


def _merge_group(key: tuple, table: pa.Table) -> pa.Table:
    """Align the wrappers of a group, largest support first; those too unlike the others stay apart."""
    ids = table.column("id").to_pylist()
    given = [Wrapper.load(w) for w in table.column("wrapper").to_pylist()]
    slots = [w.slots for w in given]
    order = sorted(range(len(ids)), key=lambda k: (-given[k].pages, given[k].shape, ids[k]))
    made: list[tuple[Wrapper, set[int], list[int]]] = []
    for k in order:
        names = given[k].names()
        for g, (w, have, members) in enumerate(made):
            if len(w.tokens) + len(given[k].tokens) <= MAX_TOKENS and alike(have, names):
                made[g] = (merge(w, given[k]), have | names, [*members, k])
                break
        else:
            made.append((given[k], names, [k]))
    out = []
    for w, have, members in made:
        place = {id(t): n for n, t in enumerate(w.slots)}
        out.append({"host": key[0].as_py(), "id": ids[members[0]], "layout": layout(have), "wrapper": w.dump(),
                    "members": [{"id": ids[k], "slots": [place[id(t.found())] for t in slots[k]]}
                                for k in members]})
    return pa.Table.from_pylist(out, pa.schema([
        ("host", pa.string()), ("id", pa.int64()), ("layout", pa.list_(pa.int64())), ("wrapper", pa.string()),
        ("members", pa.list_(pa.struct([("id", pa.int64()), ("slots", pa.list_(pa.int32()))])))]))


def infer(streams: DataFrame, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(wrappers, members): the wrappers of every host, and for each stream (host, shape) its wrapper's
    id and the wrapper's slot for every slot of the stream.

    A round aligns the wrappers of a host in groups of about ``group``; where a host has more, a group
    holds like layouts. Rounds end when a round of every seed has made no wrapper fewer.
    """
    now = streams.select("host", "id", "layout", "wrapper")
    members = None
    turn = idle = 0
    left = now.count()
    while True:
        host = now.groupBy("host").agg(F.count("*").alias("_n"))
        near = F.col("layout")[turn % SEEDS]
        same = now.groupBy("host", near.alias("_near")).agg(F.count("*").alias("_same"))
        few = F.col("_n") <= group
        dealt = now.withColumn("_near", near).join(host, "host").join(same, ["host", "_near"]).select(
            "host", "id", "wrapper", F.when(few, 0).otherwise(F.col("_near")).alias("_near"),
            F.when(few, 0).otherwise(F.pmod(F.xxhash64("id", F.lit(turn)), F.expr(
                f"1 + _same div {group}"))).alias("_salt"))
        made = materialised(dealt.groupBy("host", "_near", "_salt").applyInArrow(
            _merge_group, f"host string, {_WRAPPER}, members array<struct<id:bigint,slots:array<int>>>"), "wrappers")
        step = made.select("host", F.col("id").alias("into"), F.explode("members").alias("m")).select(
            "host", "into", F.col("m.id").alias("id"), F.col("m.slots").alias("next"))
        if members is None:
            members = streams.select("host", "shape", "id").join(step, ["host", "id"]).select(
                "host", "shape", F.col("into").alias("id"), F.col("next").alias("slots"))
        else:
            members = members.join(step, ["host", "id"]).select(
                "host", "shape", F.col("into").alias("id"),
                F.transform("slots", lambda x: F.get("next", x)).alias("slots"))
        now = made.select("host", "id", "layout", "wrapper")
        turn += 1
        rows = now.agg(F.count("*"), F.count_distinct("host")).first()
        idle = idle + 1 if rows[0] == left else 0
        left = rows[0]
        if rows[0] == rows[1] or idle >= SEEDS:
            return now, members
        members = materialised(members, "members")


def main_text(pages: DataFrame, html: str = "html", url: str = "url", prefix: str = "",
              group: int = GROUP) -> DataFrame:
    """The rows of ``pages`` without ``html``, with ``text`` and ``n_chars``.

    ``text`` is the main text: blocks in page order, joined by two line feeds, character references
    decoded, white space inside a block as one space (a line break too). NULL and empty pages, and
    pages without main text, have an empty text and 0. Pages without a host share the empty one.
    Repeated rows stay as they are and count as pages of their own; pages of any length are read
    whole. A new column whose name exists raises; choose a ``prefix``. An empty table gives no rows.
    """
    names = [prefix + "text", prefix + "n_chars"]
    others = [c for c in pages.columns if c != html]
    if clash := ({*names, "_host"} & set(others)):
        raise ValueError(f"columns {sorted(clash)} exist already, choose a prefix")
    rows, streams = read_pages(pages, html, url)
    wrappers, members = infer(streams, group)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [main_slots(Wrapper.load(w)) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("id"), pa.array(
                kept, pa.list_(pa.bool_()))], ["host", "id", "kept"])

    chosen = map_arrow(wrappers.select("host", "id", "wrapper"), choose,
                       "host string, id long, kept array<boolean>")
    # a stream may come from several tasks, with one wrapper each: its first says what is kept
    rules = materialised(members.join(chosen, ["host", "id"]).groupBy("host", "shape").agg(F.min_by(
        F.transform("slots", lambda x: F.get("kept", x)), F.col("id")).alias("kept")), "rules")
    text = F.array_join(F.transform(F.filter("blocks", lambda b: F.get("kept", b["slot"])),
                                    lambda b: b["text"]), "\n\n")
    return rows.join(rules, ["host", "shape"], "left").select(
        *[F.col("page").getField(c).alias(c) for c in others], text.alias(names[0])).withColumn(
        names[1], F.length(names[0]).cast("long"))
