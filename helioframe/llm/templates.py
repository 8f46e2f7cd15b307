"""Main text of web pages, by deducing each host's template from its pages.

*Tokens* are tags and runs of text, told apart by their place (the path of open
elements with class and id, digits left out). A token's occurrence vector says how
often it stands on each page of the host. It is never gathered: two sums of hashes
of (page, times) stand for it, which add up task by task, whatever a host's size.

*Classes.* Tokens of one vector on enough pages are an equivalence class; the sums
of their positions give their order. A class is valid when its tokens come in that
order again and again and its repeats never cross another class's; a pass over the
pages counts where that fails. The valid classes are the host's template.

*Slots* are the gaps between neighbouring tokens of a class, as many as the template
has tokens. What pages put there, added up over the host, decides whether a slot
holds main text: what its blocks say about themselves (inside the page's article,
or inside menus, adverts, comments, ...), and where no page marks its article, how
much text comes there, how much of it is links, and whether it is always the same.
Blocks outside all classes (a host of few pages shares the template of all such
hosts, and may have none) are judged by their own page alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.llm.shared import cut, schema_of
from helioframe.llm.words import U, mix
from helioframe.operators.lookup import lookup_join

#: Pages that make a template, and the share of a host's pages that a class needs.
LEAST, SHARE = 4, 0.2
#: Pages on which a class may be out of order (broken markup), as a share of its pages.
BROKEN = 0.05
#: Different main texts that the pages of constant text need; copies of one page prove nothing.
DIFFERENT = 4
#: Templates that are broadcast at most; one is some hundred numbers.
TEMPLATES = 10_000

# Names of the markup language and words that authors give to page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small
    span strike strong sub sup time tt u var wbr br img map picture source""".split())
RAW = frozenset("script style title textarea template noscript iframe noembed noframes xmp svg math canvas object".split())
FURNITURE = frozenset("""nav aside footer header form head menu dialog button select datalist fieldset audio video
    map""".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
NAMES = frozenset("""ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion
    cookie cookies consent gdpr notice notices notification newsletter subscribe subscription popup modal overlay paywall
    sidebar nav navbar navigation menu submenu breadcrumb breadcrumbs footer header masthead topbar banner
    comment comments commentlist respond replies reply disqus discussion feedback share sharing social related recommended
    recommendations widget widgets pagination pager toolbar login signup signin search searchbox skip hidden""".split())
CLOSES = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option",
          "thead": "tr", "tbody": "thead tr", "tfoot": "tbody tr"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Where an end tag or the closing of an open element stops.
SCOPES = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "table", "th": "table"}
CLOSES, SCOPES = ({k: frozenset(v.split()) for k, v in x.items()} for x in (CLOSES, SCOPES))

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^"'>]|"[^"]*+"|'[^']*+')*+)>|<!--(?:.*?-->|-?>|.*)|<[!?/][^>]*+>?""",
                 re.DOTALL)
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>?")
NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")

CHROME, CONTENT, HEADING = 1, 2, 4
MASK = (1 << 64) - 1
BLOCKS = pa.list_(pa.struct([("at", pa.int32()), ("role", pa.int64()), ("text", pa.int64()), ("chars", pa.int32()),
                             ("links", pa.int32()), ("flags", pa.int32())]))
SHAPE = ("tokens array<long>, blocks array<struct<at: int, role: long, text: long, chars: int, links: int, flags: int>>, "
         "texts array<string>")


def signed(x: int) -> int:
    return (x & MASK) - ((x & (1 << 63)) << 1)


def number(text: str, seed: int = 0) -> int:
    return signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed & MASK))


class Element:
    """An open element: its name and place, and whether it or what holds it is page furniture."""

    __slots__ = ("name", "role", "up", "chrome", "inner", "root", "link")

    def __init__(self, name: str, attributes: str, up: Element | None):
        named, own = "", name in FURNITURE
        if attributes and not attributes.isspace():
            for key, value in NAMED.findall(attributes):
                key, words = key.lower(), WORDS.findall(value.lower())
                if key in ("class", "id"):
                    named += "." + "-".join(words)
                    own = own or not NAMES.isdisjoint(words)
                elif key == "role":
                    own = own or not ROLES.isdisjoint(words)
                else:
                    own = own or (key == "hidden" and not value) or "true" in words
        if name in ("html", "body") or name == "header" and up and up.root:
            own = False  # names of the whole page say nothing; an article's header is its title
        self.name, self.up = name, up
        self.role = number(name + named, up.role if up else 0)
        self.chrome = own or bool(up and up.chrome)
        #: Furniture inside the innermost article or main part, and that part.
        self.inner, self.root = own or bool(up and up.inner), up.root if up else None
        if name in ("article", "main") and not own and (self.root is None or self.root.name == "main"):
            self.root, self.inner = self, False
        self.link = name == "a" or bool(up and up.link)


class Page:
    """A page's tokens in order, and its blocks of text."""

    def __init__(self, source: str):
        self.tokens: list[int] = []
        self.blocks: list[list] = []  # at, container, text, links, element
        self.runs: list[str] = []
        self.links, self.at = 0, 0
        self.stack: list[Element] = [Element("html", "", None)]
        self.open: Counter = Counter(["html"])
        self._read(source)
        self._end_block()
        self._choose()

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            tag = source.find("<", at)
            if tag < 0:
                tag = size
            if tag > at:
                self._text(source[at:tag])
            if tag == size:
                return
            m = TAG.match(source, tag) or LOOSE.match(source, tag)
            if not m:
                self._text("<")
                at = tag + 1
                continue
            at = m.end()
            if not m.re.groups or not m[2]:
                continue  # a comment or declaration
            name = m[2].lower()
            if m[1]:
                self._close(name)
            else:
                closed = m[3].endswith("/")
                self._open(name, m[3])
                if name in RAW and not closed:  # its text is no text of the page
                    end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(source, at)
                    at = end.start() if end else size
                    if not end:
                        self._close(name)
                elif closed and name not in VOID and name in RAW:
                    self._close(name)

    def _text(self, run: str) -> None:
        if "&" in run:
            run = html.unescape(run)
        top = self.stack[-1]
        if run.isspace():
            if self.runs:
                self.runs.append(run)
            return
        if not self.runs:
            self.at, self.holder = len(self.tokens), top
        self.runs.append(run)
        if top.link:
            self.links += len(run)
        self.tokens.append(number(run, top.role))

    def _end_block(self) -> None:
        if self.runs:
            text = " ".join("".join(self.runs).split())
            if text:
                self.blocks.append([self.at, text, min(self.links, len(text)), self.holder])
            self.runs, self.links = [], 0

    def _open(self, name: str, attributes: str) -> None:
        if name in INLINE:
            if name in VOID:
                if name == "br":
                    self.runs.append(" ") if self.runs else None
                return
            if name == "a" and self.open["a"]:
                self._close("a")
        else:
            self._end_block()
            if self.open["p"]:  # a block ends an open paragraph
                self._pop(frozenset(["p"]), frozenset(["button", "table", "td", "th"]))
            if name in CLOSES:
                self._pop(CLOSES[name], SCOPES.get(name, frozenset()))
            if name in VOID:
                return
        element = Element(name, attributes, self.stack[-1])
        self.stack.append(element)
        self.open[name] += 1
        self.tokens.append(element.role)

    def _close(self, name: str) -> None:
        if name not in INLINE:
            self._end_block()
        if self.open[name]:
            self._pop(frozenset([name]), frozenset())

    def _pop(self, names: frozenset, stops: frozenset) -> None:
        """Closes elements up to the last one of these names, unless a stop is met first."""
        if not any(self.open[x] for x in names):
            return
        depth = len(self.stack) - 1
        while depth > 0 and self.stack[depth].name not in names:
            if self.stack[depth].name in stops:
                return
            depth -= 1
        if depth > 0:
            for element in reversed(self.stack[depth:]):
                self.tokens.append(signed(~element.role))
                self.open[element.name] -= 1
            del self.stack[depth:]

    def _choose(self) -> None:
        """Marks blocks as furniture or content: the page's articles, or else its main part."""
        size: dict[int, int] = {}
        roots: dict[int, Element] = {}
        for _, text, _, holder in self.blocks:
            if holder.root is not None and not holder.inner:
                roots[id(holder.root)] = holder.root
                size[id(holder.root)] = size.get(id(holder.root), 0) + len(text)
        free = [r for r in roots.values() if not r.chrome] or list(roots.values())
        articles = [r for r in free if r.name == "article"]
        mains = [r for r in free if r.name == "main"]
        held = sum(size[id(r)] for r in articles)
        loose = sum(size[id(r)] for r in mains)
        if mains and (loose > held or not articles):
            # Text outside its articles is most of the main part: the whole part counts.
            chosen = {id(r) for r in free}
        else:
            most = max([size[id(r)] for r in articles], default=0)
            chosen = {id(r) for r in articles if 5 * size[id(r)] >= most}
        for block in self.blocks:
            holder = block[3]
            inside = holder.root is not None and id(holder.root) in chosen
            chrome = holder.inner if inside else holder.chrome
            heading, e = False, holder
            while e is not None and (e.name in INLINE or e.name in HEADINGS):
                heading = heading or e.name in HEADINGS
                e = e.up
            block.append(CHROME * chrome + CONTENT * (inside and not chrome) + HEADING * heading)


def container(element: Element) -> int:
    """The place of what holds a block: its paragraph's or heading's parent."""
    while element.up is not None and (element.name in INLINE or element.name in HEADINGS or element.name in ("p", "li")):
        element = element.up
    return element.role


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces html by tokens, blocks and the blocks' texts."""
    for batch in batches:
        tokens, blocks, texts = [], [], []
        for source in batch.column("html"):
            page = Page(source.as_py() or "")
            tokens.append(page.tokens)
            blocks.append([{"at": at, "role": container(holder), "text": number(text), "chars": len(text), "links": links,
                            "flags": flags} for at, text, links, holder, flags in page.blocks])
            texts.append([b[1] for b in page.blocks])
        keep = [c for c in batch.schema.names if c != "html"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in keep] + [pa.array(tokens, pa.list_(pa.int64())), pa.array(blocks, BLOCKS),
                                               pa.array(texts, pa.list_(pa.string()))], [*keep, "tokens", "blocks", "texts"])


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, pages, times, v1, v2, places, mains) of a batch's pages.

    v1 and v2 stand for the occurrence vector, places is the sum of positions, and mains
    marks one of 64 bits for each different main text of the pages.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        hosts = batch.column("host").dictionary_encode()
        host = hosts.indices.to_numpy()
        lists = batch.column("tokens")
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        token = lists.flatten().to_numpy(zero_copy_only=False).view(U)
        page = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.lexsort((token, page))
        token, page, place = token[order], page[order], place[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (page[1:] != page[:-1])
        opens = np.flatnonzero(new)
        if not len(opens):
            continue
        times, places = np.diff(np.append(opens, len(token))), np.add.reduceat(place, opens)
        token, page = token[opens], page[opens]
        ident = batch.column("spread").to_numpy().view(U)[page]
        main = np.array([number(max(t.as_py(), key=len, default="")) for t in batch.column("texts")], np.int64).view(U)
        v1 = mix(ident ^ mix(times.astype(U)))
        sums = {"pages": np.ones(len(token), np.int64), "times": times.astype(np.int64), "v1": v1,
                "v2": mix(v1 + U(0x9E3779B97F4A7C15)), "places": places.astype(np.int64)}
        order = np.lexsort((token, host[page]))
        token, owner = token[order], host[page][order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        opens = np.flatnonzero(new)
        bits = np.left_shift(U(1), main & U(63))[page][order]
        columns = {k: np.add.reduceat(v[order], opens) for k, v in sums.items()}
        columns["mains"] = np.bitwise_or.reduceat(bits, opens)
        yield pa.RecordBatch.from_arrays(
            [hosts.dictionary.take(pa.array(owner[opens])), pa.array(token[opens].view(np.int64)),
             *[pa.array(c.view(np.int64)) for c in columns.values()]], ["host", "token", *columns])


class Template:
    """Classes of a host, for reading its pages."""

    def __init__(self, classes: list[dict]):
        self.place = {token: (c["class"], i) for c in classes for i, token in enumerate(c["tokens"])}
        self.size = {c["class"]: len(c["tokens"]) for c in classes}

    def read(self, tokens: list[int], blocks: list[dict]) -> tuple[list, set]:
        """Each block's slot (class, token before it), or None; and the classes out of order."""
        slots, broken, stack, at = [], set(), [], 0
        starts = iter([b["at"] for b in blocks])
        want = next(starts, None)
        for at, token in enumerate(tokens):
            while want is not None and want <= at:
                slots.append((stack[-1][0], stack[-1][1]) if stack else None)
                want = next(starts, None)
            if token not in self.place:
                continue
            name, i = self.place[token]
            if i == 0 and not any(x[0] == name for x in stack):
                stack.append([name, 0])
            elif stack and stack[-1][0] == name and stack[-1][1] == i - 1:
                stack[-1][1] = i
            elif (k := next((k for k in reversed(range(len(stack))) if stack[k][0] == name), -1)) >= 0 and stack[k][1] == i - 1:
                # Classes opened since then cross this one; the smaller of two is the broken one.
                crossed = [x[0] for x in stack[k + 1:]]
                broken |= {x if self.size[x] <= self.size[name] else name for x in crossed}
                del stack[k + 1:]
                stack[k][1] = i
            else:
                broken.add(name)
            if stack and stack[-1][1] == self.size[stack[-1][0]] - 1:
                stack.pop()
        while want is not None:
            slots.append((stack[-1][0], stack[-1][1]) if stack else None)
            want = next(starts, None)
        return slots, broken | {x[0] for x in stack}


def templates(batch: pa.RecordBatch, known: dict) -> Iterator[Template]:
    """Each row's template; a group's classes are read once."""
    for group, classes in zip(batch.column("group").to_pylist(), batch.column("classes")):
        if group not in known:
            known[group] = Template(classes.as_py() or [])
        yield known[group]


def failures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, class, broken): pages on which a class is out of order or crosses a larger one."""
    known: dict = {}
    counts: Counter = Counter()
    for batch in batches:
        for group, tokens, template in zip(batch.column("group").to_pylist(), batch.column("tokens"), templates(batch, known)):
            if template.place:
                counts.update((group, x) for x in template.read(tokens.as_py(), [])[1])
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
                                      pa.array(list(counts.values()), pa.int64())], ["group", "class", "broken"])


SLOT = "blocks long, chars long, links long, chrome long, content long, headings long, pages long, low long, high long"


def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, class, gap, ...): what the pages put into every slot, added up."""
    known: dict = {}
    found: dict = {}
    for batch in batches:
        for group, tokens, blocks, template in zip(batch.column("group").to_pylist(), batch.column("tokens"),
                                                   batch.column("blocks"), templates(batch, known)):
            if not template.place:
                continue
            blocks, seen = blocks.as_py(), set()
            for slot, b in zip(template.read(tokens.as_py(), blocks)[0], blocks):
                if slot is not None:
                    t = found.setdefault((group, *slot), [0, 0, 0, 0, 0, 0, 0, b["text"], b["text"]])
                    flags = b["flags"]
                    for k, n in enumerate((1, b["chars"], b["links"], flags & 1, flags >> 1 & 1, flags >> 2 & 1, slot not in seen)):
                        t[k] += n
                    t[7], t[8] = min(t[7], b["text"]), max(t[8], b["text"])
                    seen.add(slot)
    keys = list(found)
    names = [x.split()[0] for x in SLOT.split(", ")]
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int32())]
        + [pa.array([t[i] for t in found.values()], pa.int64()) for i in range(len(names))], ["group", "class", "gap", *names])


def alone(blocks: list[dict]) -> list[bool]:
    """Which blocks are main text as far as their own page tells."""
    if any(b["flags"] & CONTENT for b in blocks):
        return [bool(b["flags"] & CONTENT) for b in blocks]
    chars: Counter = Counter()
    links: Counter = Counter()
    for b in blocks:
        if not b["flags"] & (CHROME | HEADING):
            chars[b["role"]] += b["chars"]
            links[b["role"]] += b["links"]
    most = max((n for role, n in chars.items() if 2 * links[role] < n), default=0)
    good = {role for role, n in chars.items() if 2 * links[role] < n and 5 * n >= most}
    return [not b["flags"] & CHROME and (b["role"] in good or bool(b["flags"] & HEADING)) for b in blocks]


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, n_chars): the blocks of main slots, and those outside all classes that their page tells."""
    known: dict = {}
    chosen: dict = {}
    for batch in batches:
        out = []
        for group, mains, tokens, blocks, texts, template in zip(
                batch.column("group").to_pylist(), batch.column("mains"), batch.column("tokens"), batch.column("blocks"),
                batch.column("texts"), templates(batch, known)):
            if group not in chosen:
                chosen[group] = {(m["class"], m["gap"]) for m in mains.as_py() or ()}
            blocks = blocks.as_py()
            slots = template.read(tokens.as_py(), blocks)[0] if template.place else [None] * len(blocks)
            own = alone(blocks) if None in slots else [False] * len(blocks)
            out.append(" ".join(text for text, slot, b, mine in zip(texts.as_py(), slots, blocks, own)
                                if (mine if slot is None else slot in chosen[group] and not b["flags"] & CHROME)))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                                         ["row", "text", "n_chars"])


def host_of(url: Column) -> Column:
    """The host of an address, in lower case; empty for none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def deduce(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, group), and (group, classes): the classes of one vector, in order, before they are tried.

    `pages` has host, spread, tokens and texts. A host of few pages belongs to the group "".
    """
    per_host = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    groups = cut(per_host.select("host", F.when(F.col("n") >= LEAST, F.col("host")).otherwise("").alias("group"), "n"))
    sizes = groups.groupBy("group").agg(F.sum("n").alias("n_pages"))
    shape = "host string, token long, " + ", ".join(f"{c} long" for c in ("pages", "times", "v1", "v2", "places", "mains"))
    sums = lambda c: F.sum(c).alias(c)
    # Sums of hashes wrap around; that is as good, and the same in every order.
    wrapped = lambda c: F.expr(f"pmod(sum(cast({c} AS decimal(20,0))), 18446744073709551616)").alias(c)
    first = pages.select("host", "spread", "tokens", "texts").mapInArrow(vectors, shape)
    tokens = lookup_join(first, groups.select("host", "group"), ["host"], "token").groupBy("group", "token").agg(
        sums("pages"), sums("times"), wrapped("v1"), wrapped("v2"), sums("places"), F.bit_or("mains").alias("mains"))
    tokens = lookup_join(tokens.where(F.col("pages") >= LEAST), sizes, ["group"], "token")
    tokens = tokens.where(F.col("pages") >= SHARE * F.col("n_pages"))
    # So frequent tokens of a host are at most 1 / SHARE times as many as a page has on the mean.
    classes = (tokens.groupBy("group", "pages", "times", "v1", "v2").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("places", "token"))), lambda t: t["token"]).alias("tokens"),
        F.max(F.bit_count("mains")).alias("different"))
        .where(F.size("tokens") > 1).withColumn("class", F.xxhash64("pages", "times", "v1", "v2")))
    return groups.select("host", "group"), cut(classes.select("group", "class", "pages", "different", "tokens"))


def gathered(classes: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, classes) for every group."""
    found = classes.groupBy("group").agg(F.collect_list(F.struct("class", "tokens")).alias("classes"))
    return groups.select("group").distinct().join(found, "group", "left")


def main_text(pages: DataFrame, keep: list[str], url: str = "url", source: str = "html") -> DataFrame:
    """Columns `keep`, text and n_chars (code points), for every row.

    `text` holds the blocks of main text in page order, joined by one space: character
    references decoded, white space within a block (as Unicode has it, and line breaks)
    turned into one space, no markup. Null and empty pages have an empty text. A missing
    or unreadable address counts as a host of its own, "". Repeated rows get equal texts.
    Kept columns named text or n_chars give way to the result's. An empty table stays empty.
    """
    kept = [c for c in dict.fromkeys(keep) if c not in ("text", "n_chars")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("int").alias("\x00")).alias("row")
    text = F.col(f"`{source}`").cast("string")
    read = pages.select(row, host_of(F.col(f"`{url}`").cast("string")).alias("host"),
                        F.xxhash64(F.col(f"`{url}`").cast("string"), text).alias("spread"), text.alias("html"))
    parsed = cut(read.mapInArrow(parse, schema_of(read, ["row", "host", "spread"], SHAPE)))
    groups, classes = deduce(parsed)
    placed = lambda *names: lookup_join(parsed.select("host", "spread", *names), groups, ["host"], "spread")
    told = lambda frame, with_: lookup_join(frame, with_, ["group"], "spread", TEMPLATES)

    failed = (told(placed("tokens"), cut(gathered(classes, groups))).select("group", "tokens", "classes")
              .mapInArrow(failures, "group string, class long, broken long")
              .groupBy("group", "class").agg(F.sum("broken").alias("broken")))
    classes = cut(classes.join(failed, ["group", "class"], "left")
                  .where(F.coalesce("broken", F.lit(0)) <= BROKEN * F.col("pages")).drop("broken"))
    known = cut(gathered(classes, groups))
    filled = (told(placed("tokens", "blocks"), known).select("group", "tokens", "blocks", "classes")
              .mapInArrow(contents, f"group string, class long, gap int, {SLOT}")
              .groupBy("group", "class", "gap").agg(
                  *[F.sum(c).alias(c) for c in ("blocks", "chars", "links", "chrome", "content", "headings", "pages")],
                  F.min("low").alias("low"), F.max("high").alias("high")))
    filled = cut(filled.join(classes.select("group", "class", "different"), ["group", "class"]))
    fair = F.expr("2 * chrome < blocks AND 2 * links < chars AND NOT (low = high AND pages > 1 AND "
                  f"different >= {DIFFERENT})")
    whole = filled.groupBy("group").agg(F.sum("content").alias("marked"),
                                        F.max(F.when(fair, F.col("chars"))).alias("most"))
    main = F.when(F.col("marked") > 0, F.expr("2 * content >= blocks")).otherwise(
        fair & (F.expr("5 * chars >= most") | F.expr("2 * headings >= blocks")))
    mains = (filled.join(whole, "group").where(main).groupBy("group")
             .agg(F.collect_list(F.struct("class", "gap")).alias("mains")))
    last = told(placed("row", "tokens", "blocks", "texts"), cut(known.join(mains, "group", "left")))
    found = last.select("row", "group", "tokens", "blocks", "texts", "classes", "mains").mapInArrow(
        extract, schema_of(parsed, ["row"], "text string, n_chars long"))
    return found.select(*[F.col("row").getField(c).alias(c) for c in kept], "text", "n_chars")
