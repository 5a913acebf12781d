"""Operator 1: main text of web pages by equivalence classes of tokens.

All pages of a host are compared, however many they are. A token is a tag or a text block together with
its path of open elements; its occurrence vector says how often each page of the host holds it. Tokens
with equal vectors form an equivalence class; pages of equal tokens (copies) count as one page. A class
is valid if it is ordered (on every page its tokens stand in one order, repeat by repeat) and if it nests
in the valid classes taken before it: each of its repeats lies within one gap of theirs. Valid classes on
a quarter of the host's pages or more, largest support first, make up the host's template; what stands
between two neighbouring template tags is a slot. Hosts of fewer than CONSTANT_PAGES distinct pages have
no template: there each page's own tags bound its slots.

Slots are judged as wholes. A slot is boilerplate if its path leads through an element that is not
content (head, nav, header, footer, aside, form, script ...; or by name: menu, sidebar, comments,
notice, ad ...), or, outside an article, if most of its characters are links. Text of the template that
stands on more than half of the host's pages is boilerplate outside an article; inside one it goes only as a
whole paragraph of EVERYWHERE_WORDS or more that every page holds, of EVERYWHERE_PAGES or more. If the page has an article (article or main element, or an
element named so), its slots are the main text; else the remaining slots are. Names never blank an
outermost article or main element, and where they would leave a page without any text, only elements count.

How it runs: each page is parsed once into keys (64-bit hashes of tokens), flags and texts, and written.
Vectors are not built: a token's support, total and two XORs of hashes of (page, count) stand for its
vector, which Spark adds up per (host, token), on each task before the shuffle. A host's template is one row of at
most four times the mean number of tokens of its pages. Orders and crossings of classes are looked up on
all pages and only distinct findings are kept. Templates go to the pages by broadcast while they are
counted to be few, else by a join in which a host with more than 1/4096 of all pages is dealt over several
keys. No task holds the pages of a host.

Defined results: null, empty or tagless html gives its text or the empty string; markup that is not
closed is closed by its parents' ends; repeated page_ids are pages of their own; a null url is a host
of its own; extra columns are ignored. A page's text depends on the set of its host's pages, not on their
order, number of copies or partitions.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._io import arrow_limits, materialise

#: Distinct pages a host must have for a template.
CONSTANT_PAGES = 3
#: Distinct pages a host must have for text on all of them to be boilerplate even inside an article.
EVERYWHERE_PAGES = 5
#: Words such a text must have; shorter ones (headings, items) may well recur in articles.
EVERYWHERE_WORDS = 3
#: A class is in the template if one page in so many holds it.
TEMPLATE_SHARE = 4
HOT_SHARE = 4096
#: Template entries in all hosts together, up to which templates are broadcast (some 20 bytes each).
BROADCAST_ENTRIES = 1 << 18

TEXT, NEVER, MAIN, LINK, BREAKS, HARD, EDGE = (1 << i for i in range(7))

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
#: Elements whose text is never part of the main text.
_NEVER = frozenset("head title nav footer aside form script style noscript iframe template textarea select button svg canvas object dialog menu datalist".split())
#: Elements that continue the line they stand in; all others begin a new block.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar comment comments disqus notice notices cookie cookies consent "
    "gdpr nav navbar navigation menu footer masthead breadcrumb breadcrumbs share sharing social related recommended popup modal overlay newsletter subscribe subscription widget "
    "pager pagination toolbar login signup alert warning disclaimer replies respond skip".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar form".split())
_MAIN_NAMES = frozenset("article main content post entry story".split())
#: Elements that an opening tag of the same kind closes.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.S)
_SPACE = re.compile(r"\s+")


@dataclass
class Token:
    """A tag or a piece of text in a page; role: what makes two tokens the same across pages."""

    role: tuple
    text: str = ""
    never: bool = False
    main: bool = False
    link: bool = False
    breaks: bool = False
    hard: bool = False
    template: bool = field(default=False, compare=False)

    @property
    def key(self) -> int:
        """63 bits of the role; 0 for white space."""
        if self.role[1] == "text" and not self.role[2]:
            return 0
        return _hash(f"{self.role[0]}|{self.role[1]}|{self.role[2]}") or 1

    @property
    def flags(self) -> int:
        return (self.role[1] == "text") * TEXT | self.never * NEVER | self.main * MAIN | self.link * LINK | self.breaks * BREAKS | self.hard * HARD | (self.breaks and self.role[2] != "br") * EDGE


def _hash(value: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")) >> 1


def _words(value: str) -> set[str]:
    return set(re.split(r"[^a-z0-9]+", value.lower()))


def _kind(name: str, attributes: str, in_main: bool) -> tuple[bool, bool, bool, str]:
    """Whether an element never holds main text by its kind, or by its names as well; whether it is the article; its label in paths."""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    named = _words(found.get("class", "") + " " + found.get("id", ""))
    role = found.get("role", "").lower()
    hard = name in _NEVER or "hidden" in attributes.lower().split() or "display:none" in found.get("style", "").replace(" ", "").lower()
    hard |= name == "header" and not in_main
    outermost = name in ("article", "main") and not in_main
    never = hard or not outermost and (bool(named & _NAMES) or role in _ROLES)
    main = name in ("article", "main") or role in ("main", "article") or (name not in ("body", "html") and bool(named & _MAIN_NAMES))
    return hard, never, main and not never, " ".join(sorted(named - {""}))


def tokens(page: str) -> list[Token]:
    """Tags and text pieces of a page, with character references decoded."""
    out: list[Token] = []
    stack: list[tuple[str, bool, bool, bool, bool, int]] = [("", False, False, False, False, 0)]  # name, never, main, link, hard, path (a hash of it)

    def say(text: str) -> None:
        if text:
            _, never, main, link, hard, path = stack[-1]
            text = _html.unescape(text)
            out.append(Token((path, "text", _SPACE.sub(" ", text).strip()), text, never, main, link, hard=hard))

    def close(upto: int) -> None:
        while len(stack) > upto:
            name, never, main, link, hard, path = stack.pop()
            out.append(Token((path, "end", name), "", never, main, link, name not in _INLINE, hard))

    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if not found:
            break
        say(page[at : found.start()])
        at = found.end()
        if not found[2]:
            if found[0].startswith("<![CDATA["):
                say(_html.escape(found[0][9:].removesuffix("]]>")))
            continue
        name, rest = found[2].lower(), found[3]
        if found[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if depth:
                close(depth)
            elif name in ("p", "br"):
                out.append(Token((stack[-1][5], "lone", name), breaks=True))
            continue
        closes = _CLOSES.get(name, frozenset()) | ({"p"} if name in _CLOSE_P else set())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in closes:
                close(i)
                break
            if stack[i][0] not in _INLINE and not (stack[i][0] == "p" and name in _CLOSE_P):
                break
        _, never, main, link, hard, path = stack[-1]
        own_hard, own_never, own_main, label = _kind(name, rest, main)
        path = _hash(f"{path}/{name}.{label}")
        never, main, link, hard = never or own_never, main or own_main, link or name == "a", hard or own_hard
        out.append(Token((path, "start", name), "", never, main, link, name not in _INLINE, hard))
        if name in _VOID or rest.endswith("/") and name not in _RAW and name not in ("p", "div", "a", "article", "section", "li", "ul", "span"):
            continue
        stack.append((name, never, main, link, hard, path))
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            stop = end.start() if end else n
            say(page[at:stop])
            at = stop
    say(page[at:])
    close(1)
    return out


def least_support(pages: int) -> int:
    """Pages that must hold a class of the template, of a host's distinct pages."""
    return max(2, -(-pages // TEMPLATE_SHARE))


def equivalence_classes(entries: list[tuple]) -> list[list[int]]:
    """Keys with equal vectors, largest support first, from (support, total, two hashes of the vector, key)."""
    classes: dict[tuple, list[int]] = defaultdict(list)
    for support, total, first, second, key in entries:
        classes[(-support, total, first, second)].append(key)
    return [sorted(keys) for _, keys in sorted(classes.items())]


def findings(keys: list[int], of: dict[int, int], n_classes: int) -> set[tuple[int, int, int]]:
    """What one page, given as its template keys in order, says of classes: (0, class, its order) and (1, class, one it crosses).

    An order is a hash; -1 says that the class's repeats overlap or differ in order.
    """
    where: list[dict[int, list[int]]] = [{} for _ in range(n_classes)]
    for i, key in enumerate(keys):
        where[of[key]].setdefault(key, []).append(i)
    out: set[tuple[int, int, int]] = set()
    bounds: list[tuple[int, list[int]]] = []  # single repeats of classes so far, which later ones must not cross
    for c, places in enumerate(where):
        if not places:
            continue
        columns = list(places.items())
        order, repeats = None, []
        for k in range(len(columns[0][1])):
            own = sorted((at[k], key) for key, at in columns)
            sequence = [key for _, key in own]
            if order not in (None, sequence) or repeats and repeats[-1][-1] >= own[0][0]:
                out.add((0, c, -1))
            order = sequence
            repeats.append([i for i, _ in own])
        out.add((0, c, _hash(repr(order))))
        for d, taken in bounds:
            if any(bisect_left(taken, r[0]) != bisect_left(taken, r[-1]) for r in repeats):
                out.add((1, c, d))
        if len(repeats) == 1 and len(columns) > 1:
            bounds.append((c, repeats[0]))
    return out


def valid_classes(n_classes: int, found) -> list[int]:
    """Classes of one order everywhere that cross no valid class before them."""
    orders, crossed = defaultdict(set), defaultdict(set)
    for kind, c, x in found:
        (crossed if kind else orders)[c].add(x)
    taken: set[int] = set()
    for c in range(n_classes):
        if orders[c] and len(orders[c]) == 1 and -1 not in orders[c] and not crossed[c] & taken:
            taken.add(c)
    return sorted(taken)


def template(pages: list[list[int]]) -> dict[int, int] | None:
    """Key -> support for the template of a host's pages, given as their keys; None if the host has too few."""
    distinct = sorted(set(map(tuple, pages)))
    if len(distinct) < CONSTANT_PAGES:
        return None
    vectors: dict[int, list[int]] = defaultdict(lambda: [0] * len(distinct))
    for i, page in enumerate(distinct):
        for key in page:
            if key:
                vectors[key][i] += 1
    entries = [(sum(x > 0 for x in v), sum(v), hash(tuple(v)), 0, key) for key, v in vectors.items()]
    support = {key: n for n, *_, key in entries}
    classes = equivalence_classes([x for x in entries if x[0] >= least_support(len(distinct))])
    of = {key: c for c, keys in enumerate(classes) for key in keys}
    found = set().union(*(findings([k for k in page if k in of], of, len(classes)) for page in distinct))
    return {key: support[key] for c in valid_classes(len(classes), found) for key in classes[c]}


def mark_template(pages: list[list[Token]]) -> None:
    """Set template on the tokens of a host's pages that are in its template."""
    found = template([[token.key for token in page] for page in pages]) or {}
    for page in pages:
        for token in page:
            token.template = token.key in found


def _everywhere(keys, flags, texts, found: dict[int, int], pages: int) -> set[int]:
    """Places of the texts of paragraphs that stand as a whole on all pages of the host."""
    out: set[int] = set()
    paragraph: list[int] = []
    for i in range(len(keys) + 1):
        if i == len(keys) or flags[i] & EDGE:
            if sum(len(texts[k].split()) for k in paragraph) >= EVERYWHERE_WORDS and all(found.get(keys[k]) == pages for k in paragraph):
                out.update(paragraph)
            paragraph = []
        elif flags[i] & TEXT and keys[i]:
            paragraph.append(i)
    return out


def blocks_of(keys, flags, texts, found: dict[int, int] | None, pages: int) -> list[str]:
    """The blocks of main text of one page; found: the host's template, pages: the host's distinct pages.

    Slots begin at tags of the template (without one, at every tag); each is judged as a whole.
    """
    said = [len(" ".join(x.split())) if f & TEXT else 0 for f, x in zip(flags, texts, strict=True)]
    never = NEVER if any(n and not f & NEVER for f, n in zip(flags, said, strict=True)) else HARD
    has_main = any(n and f & MAIN and not f & never for f, n in zip(flags, said, strict=True))
    everywhere = _everywhere(keys, flags, texts, found, pages) if has_main and found and pages >= EVERYWHERE_PAGES else set()
    slots: list[list[int]] = [[]]
    for i, (key, f) in enumerate(zip(keys, flags, strict=True)):
        if not f & TEXT and (found is None or key in found):
            slots.append([])
        slots[-1].append(i)
    out = [""]
    for slot in slots:
        content = [i for i in slot if said[i]]
        links = sum(said[i] for i in content if flags[i] & LINK)
        boilerplate = bool(content) and (all(flags[i] & never for i in content) or not has_main and 2 * links > sum(said[i] for i in content))
        for i in slot:
            f = flags[i]
            if f & BREAKS:
                out.append("")
                continue
            if boilerplate or not f & TEXT or f & never or has_main and not f & MAIN:
                continue
            support = (found or {}).get(keys[i], 0)
            if i in everywhere or not has_main and 2 * support > pages and support >= CONSTANT_PAGES:
                continue
            out[-1] += texts[i]
    return [x for x in (_SPACE.sub(" ", b).strip() for b in out) if x]


def parse(page: str) -> tuple[list[int], bytes, list[str]]:
    """Keys, flags and texts of a page's tokens; texts that no verdict could keep are left out."""
    found = tokens(page)
    return [x.key for x in found], bytes(x.flags for x in found), ["" if x.hard else x.text for x in found]


def extract(group: list[str]) -> list[tuple[str, list[str]]]:
    """Main text and its blocks for all pages of one host, in memory."""
    pages = [parse(x) for x in group]
    found = template([keys for keys, _, _ in pages])
    distinct = len({tuple(keys) for keys, _, _ in pages})
    return [(" ".join(b), b) for b in (blocks_of(*page, found, distinct) for page in pages)]


def _parsed(batches):
    import xxhash

    for batch in batches:
        page_id, url, html, host = batch.columns
        pages = [parse(x) for x in html.to_pylist()]
        signs = [xxhash.xxh3_64_intdigest(np.array(keys, "<i8").tobytes()) >> 1 for keys, _, _ in pages]
        columns = [page_id, url, host, pa.array(signs, pa.int64()), pa.array([k for k, _, _ in pages], pa.list_(pa.int64())), pa.array([f for _, f, _ in pages], pa.binary()), pa.array([t for _, _, t in pages], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "host", "sign", "keys", "flags", "texts"])


def _packed(batches):
    """A host's entries as classes: keys and, for each, its class and support."""
    for batch in batches:
        out = []
        for entries in batch.column("entries").to_pylist():
            rows = [(x["support"], x["total"], x["first"], x["second"], x["key"]) for x in entries]
            support = {key: n for n, *_, key in rows}
            out.append(np.array([(key, c, support[key]) for c, keys in enumerate(equivalence_classes(rows)) for key in keys], "<i8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("pages"), pa.array(out, pa.binary())], names=["host", "pages", "packed"])


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<i8").reshape(-1, 3)


def _found(batches):
    """Distinct findings of the pages of a batch, by host."""
    for batch in batches:
        classes: dict[str, tuple[dict[int, int], int]] = {}
        seen, out = set(), set()
        for host, keys, packed in zip(batch.column("host").to_pylist(), batch.column("keys"), batch.column("packed"), strict=True):
            if host not in classes:
                rows = _unpacked(packed.as_py())
                classes[host] = {key: c for key, c, _ in rows.tolist()}, int(rows[:, 1].max(initial=-1)) + 1
            of, n = classes[host]
            page = tuple(k for k in keys.values.to_numpy().tolist() if k in of)
            if (host, page) not in seen:
                seen.add((host, page))
                out |= {(host, *x) for x in findings(page, of, n)}
        rows = sorted(out)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64() if i else pa.string()) for i in range(4)], names=["host", "kind", "class", "x"])


def _resolved(batches):
    """A host's template: the keys of valid classes and their support."""
    for batch in batches:
        out = []
        for packed, found in zip(batch.column("packed").to_pylist(), batch.column("found").to_pylist(), strict=True):
            rows = _unpacked(packed)
            taken = valid_classes(int(rows[:, 1].max(initial=-1)) + 1, [(x["kind"], x["class"], x["x"]) for x in found or []])
            out.append(rows[np.isin(rows[:, 1], taken)].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("pages"), pa.array(out, pa.binary())], names=["host", "pages", "packed"])


def _texts(batches):
    for batch in batches:
        templates: dict[str, dict[int, int] | None] = {}
        blocks = []
        columns = (batch.column(x).to_pylist() for x in ("host", "keys", "flags", "texts", "packed", "pages"))
        for host, keys, flags, texts, packed, pages in zip(*columns, strict=True):
            if host not in templates:
                templates[host] = None if packed is None else {key: n for key, _, n in _unpacked(packed).tolist()}
            blocks.append(blocks_of(keys, flags, texts, templates[host], pages or 0))
        text = pa.array([" ".join(b) for b in blocks], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), text, pa.array(blocks, pa.list_(pa.string()))], names=["page_id", "url", "text", "blocks"])


def _beside(rows: DataFrame, templates: DataFrame, hot: DataFrame, few: bool, how: str) -> DataFrame:
    """rows with their host's template; hosts above their share are dealt over salts unless templates are few enough to broadcast."""
    if few:
        return rows.join(F.broadcast(templates), "host", how)
    rows = rows.join(F.broadcast(hot), "host", "left").withColumn("salt", F.coalesce(F.expr("pmod(xxhash64(page_id, url), salts)"), F.lit(0)))  # hot: fewer than HOT_SHARE hosts
    dealt = templates.join(F.broadcast(hot), "host", "left").withColumn("salt", F.explode(F.expr("sequence(0L, coalesce(salts, 1L) - 1)")))
    return rows.drop("salts").join(dealt.drop("salts"), ["host", "salt"], how)


def host_templates(parsed: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> tuple[DataFrame, DataFrame, bool]:
    """host, pages (distinct ones), packed (template) of hosts that have one; hosts above their share of pages; whether templates are few."""
    hosts = materialise(parsed.groupBy("host").agg(F.count("*").alias("n"), F.count_distinct("sign").alias("pages")))
    share = max(1024, -(-(hosts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE))
    hot = hosts.filter(F.col("n") > share).select("host", F.ceil(F.col("n") / share).alias("salts"))
    distinct = parsed.select("host", "sign", "keys").dropDuplicates(["host", "sign"])
    counts = distinct.select("host", "sign", F.explode("keys").alias("key")).filter("key <> 0").groupBy("host", "sign", "key").agg(F.count("*").alias("n"))
    vectors = counts.groupBy("host", "key").agg(
        F.count("*").alias("support"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("sign", "n")).alias("first"), F.bit_xor(F.xxhash64("n", "sign", F.lit(1))).alias("second")
    )
    large = hosts.filter(F.col("pages") >= CONSTANT_PAGES).select("host", "pages")
    entries = vectors.filter("support > 1").join(large, "host").filter(F.expr(f"support >= ceil(pages / {TEMPLATE_SHARE})"))
    rows = entries.groupBy("host", "pages").agg(F.collect_list(F.struct("support", "total", "first", "second", "key")).alias("entries"))
    packed = materialise(rows.mapInArrow(_packed, "host string, pages long, packed binary"))
    few = (packed.agg(F.sum(F.length("packed") / 24)).first()[0] or 0) <= broadcast_entries
    pages = _beside(parsed.select("page_id", "url", "host", "keys"), packed, hot, few, "inner")
    found = pages.select("host", "keys", "packed").mapInArrow(_found, "host string, kind long, class long, x long").distinct()
    found = found.groupBy("host").agg(F.collect_list(F.struct("kind", "class", "x")).alias("found"))
    resolved = packed.join(found, "host", "left").mapInArrow(_resolved, "host string, pages long, packed binary")
    return materialise(resolved), hot, few


def main_text(pages: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """page_id, url, text, blocks for every row of pages (page_id, url, html)."""
    arrow_limits(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    parsed = materialise(rows.withColumn("host", host).mapInArrow(_parsed, "page_id long, url string, host string, sign long, keys array<long>, flags binary, texts array<string>"))
    found = _beside(parsed, *host_templates(parsed, broadcast_entries), "left")
    return found.select("page_id", "url", "host", "keys", "flags", "texts", "packed", "pages").mapInArrow(_texts, "page_id long, url string, text string, blocks array<string>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
