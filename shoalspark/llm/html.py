"""Main text of web pages by nearest-URL page differencing.

A page is read once into lines: the text of each block, character references
decoded, white space folded, with the zone it stands in: ``article`` (inside
an article or main element), ``fixed`` (menus, headers, footers, sidebars,
notices, adverts, forms and reader comments, told by element, role, class or
id) or ``page`` (the rest of the body). Scripts, styles and markup give no
lines.

The pages of a host are put in URL order by path, equal ones as one, and each
page is paired with the neighbour whose path shares more with its own (the
earlier one on ties): copies of a page share its partner, so equal pages give
equal texts. All lines of the two are aligned by a longest common subsequence,
and shared lines are deleted. Pages with an article and those without one are
ordered apart: for the latter, pages are equal if their lines outside an
article are, and only those lines are aligned.

A check of the tags follows. Lines that are left but stand in zone ``fixed``,
or outside the article of a page that has one, go. A shared line of an article
comes back, since pages of one host do carry the same lines in their stories,
unless differencing tells furniture: it stands in a container of the article
(``CONTAINERS``, known by the tags and classes from the article down to it) of
which every line is shared, here and in nine of ten pages of the host that have
such a container, of five at least. Pages half of whose story is the same as
their partner's have no say in this, and a container of headings alone is none.

The order is cut into ranges of about ``group`` different pages, and neighbours
are carried over the cuts, so the result depends neither on ``group`` nor on the
size of a host or folder; what is ordered and aligned is paths and hashes, no
text. A page is read twice: for its hashes, and for its text, which meets what
was decided on its class in one join, where a class of many copies is dealt.

Null html gives an empty text; a page whose URL is null or that is alone in its
host has no pair and loses no line. Repeated rows have one result each. Pages of
any length are read whole, in time that follows their length: a tag whose quote
is never closed ends at the next ``>``, one that never ends takes the rest.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

GROUP = 20_000
HOT = 5_000
MANY, MOST = 5, 0.9
LCS_BITS = 1 << 28
# Element names by their meaning in HTML, and the words that name page furniture.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FIXED_TAGS = frozenset("nav aside footer form button select option dialog menu noscript iframe template svg canvas object audio video map datalist label fieldset".split())
RAW_TAGS = frozenset("script style title textarea noscript iframe template xmp noembed noframes svg".split())
CONTAINERS = frozenset("div dl figure ol section table ul".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
FIXED_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer masthead cookie cookies consent gdpr notice notices disclaimer popup modal newsletter subscribe subscription signup login share sharing social comment comments respond replies disqus related recommended pagination pager toolbar skip".split())
FIXED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_BEGINS = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_RAW_END = {t: re.compile(rf"</{t}\s*(?=[\s/>])", re.I) for t in RAW_TAGS}
ARTICLE, FIXED, PAGE = "a", "f", "p"
_OVER_P = BLOCK_TAGS - {"p"}


def _is_fixed(attrs: str) -> bool:
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden":
            return True
        if name == "role" and value in FIXED_ROLES:
            return True
        if name in ("class", "id") and not FIXED_WORDS.isdisjoint(_WORD.findall(value)):
            return True
    return False


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _place(above: int, tag: str, attrs: str) -> int:
    words = " ".join(" ".join(sorted((m[2] or m[3] or m[4] or "").lower().split())) for m in _ATTR.finditer(attrs) if m[1].lower() == "class")
    return _digest(f"{above} {tag} {words}")


def read_lines(page: str, inside: list[tuple[int, int, int]] | None = None) -> list[tuple[str, str]]:
    """(zone, line) of each block, in page order; ``inside`` gets (place, first line, end) of each container in an article."""
    out: list[tuple[str, str]] = []
    marks: list[tuple[int, int, int, int]] = []  # depth, lines and lines beside headings so far, place
    said = 0
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, fixed, article
    opened: Counter = Counter()
    fixed = article = 0
    at = 0
    n = len(page)

    def flush():
        nonlocal said
        if text:
            line = " ".join("".join(text).split())
            text.clear()
            if line:
                out.append((FIXED if fixed else ARTICLE if article else PAGE, line))
                said += bool(marks) and not fixed and not any(opened[h] for h in HEADINGS)

    def close(k: int):
        nonlocal fixed, article
        for t, f, a in stack[k:]:
            opened[t] -= 1
            fixed -= f
            article -= a
        del stack[k:]
        while marks and marks[-1][0] >= k:
            _, first, before, place = marks.pop()
            if said > before:
                inside.append((place, first, len(out)))

    def find(tag: str, fence: frozenset | tuple = ()) -> int:
        for k in range(len(stack) - 1, -1, -1) if opened[tag] else ():
            if stack[k][0] == tag:
                return k
            if stack[k][0] in fence:
                return -1
        return -1

    while at < n:
        lt = page.find("<", at)
        end = n if lt < 0 else lt
        m = _TAG.match(page, lt) if lt >= 0 else None
        plain = lt >= 0 and m is None and page[lt + 1 : lt + 2] not in ("!", "?") and not _BEGINS.match(page, lt)
        piece = page[at : end + plain]
        if piece:
            text.append(entities.unescape(piece) if "&" in piece else piece)
        if lt < 0:
            break
        if plain:
            at = lt + 1
            continue
        if m is None:  # a comment, a declaration, or a tag that never ends
            mark = "-->" if page.startswith("<!--", lt) else ">"
            stop = page.find(mark, lt + (4 if mark == "-->" else 1)) if page[lt + 1 : lt + 2] in ("!", "?") else -1
            at = n if stop < 0 else stop + len(mark)
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            k = find(tag)
            if k >= 0:
                if stack[k][1]:
                    flush()
                close(k)
            continue
        if tag in RAW_TAGS:
            end = _RAW_END[tag].search(page, at)
            stop = page.find(">", end.end()) if end else -1
            at = n if not end or stop < 0 else stop + 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
            k = find("p", _OVER_P)
            if k >= 0:
                close(k)
            if tag == "li" and (k := find("li", ("ul", "ol", "menu"))) >= 0:
                close(k)
        if tag in VOID_TAGS:
            continue
        attrs = m[3]
        is_article = tag in ("article", "main") or "main" in attrs and re.search(r"role\s*=\s*[\"']?main\b", attrs) is not None
        is_fixed = tag in FIXED_TAGS or tag == "header" and not article or bool(attrs) and tag not in ("html", "body", "article", "main") and _is_fixed(attrs)
        if is_fixed:
            flush()
        if attrs.rstrip().endswith("/") and not block:
            continue
        if inside is not None and article and not fixed and not is_fixed and tag in CONTAINERS:
            marks.append((len(stack), len(out), said, _place(marks[-1][3] if marks else 0, tag, attrs)))
        stack.append((tag, is_fixed, is_article))
        opened[tag] += 1
        fixed += is_fixed
        article += is_article
    flush()
    close(0)
    return out


def _steps(a: list[int], b: list[int], keep: list[int] | None = None) -> int:
    """Bit-parallel LCS (Crochemore et al. 2001): bit j is 0 where the length grows at b[j], for all of ``a``; ``keep`` gets every row."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    v = every
    for x in a:
        u = v & where.get(x, 0)
        v = (v + u | v - u) & every
        if keep is not None:
            keep.append(v)
    return v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the LCS of ``a`` with each beginning of ``b``."""
    bits = np.unpackbits(np.frombuffer(_steps(a, b).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def _matched(a: list[int], b: list[int], base: int, out: list[bool]) -> None:
    if not a or not b:
        return
    if len(a) > 1 and len(a) * len(b) > LCS_BITS:  # halves (Hirschberg 1975), so that no more rows are held
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        _matched(a[:half], b[:cut], base, out)
        _matched(a[half:], b[cut:], base + half, out)
        return
    rows: list[int] = []
    _steps(a, b, rows)
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if not i or rows[i - 1] >> (j - 1) & 1:
            out[base + i] = True
            j -= 1


def shared(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of ``a`` a longest common subsequence with ``b`` holds: equal ends are trimmed, then only lines of both count."""
    out = [False] * len(a)
    lo, hi = 0, 0
    most = min(len(a), len(b))
    while lo < most and a[lo] == b[lo]:
        out[lo] = True
        lo += 1
    while hi < most - lo and a[-1 - hi] == b[-1 - hi]:
        out[-1 - hi] = True
        hi += 1
    a_, b_ = a[lo : len(a) - hi], b[lo : len(b) - hi]
    both = {x: k for k, x in enumerate(set(a_) & set(b_))}
    at = [i for i, x in enumerate(a_) if x in both]
    found = [False] * len(at)
    _matched([both[a_[i]] for i in at], [both[x] for x in b_ if x in both], 0, found)
    for i, f in zip(at, found):
        out[lo + i] = f
    return out


def _common(a: str, b: str) -> int:
    k = 0
    for x, y in zip(a, b):
        if x != y:
            break
        k += 1
    return k


def beside(rows: DataFrame, by: str, order: list[str], group: int, count: int, carry: tuple = ()) -> DataFrame:
    """``rows`` (about ``count``, all different in ``by`` and ``order``) with ``before`` and ``after``: structs of their neighbours in order and what these ``carry``, NULL at the ends of ``by``.

    Rows are cut into ranges of the whole order; each range finds its neighbours by itself, and its ends
    are carried to the ranges next to it. One task sees one range, or one row for each of the ranges.
    """
    keys = [by, *order]
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // group + 1)
    cut = materialize(rows.repartitionByRange(n, *keys).withColumn("range", F.spark_partition_id()), "ranges")
    here = F.struct(*keys, *carry)
    ends = cut.groupBy("range").agg(F.min(here).alias("head"), F.max(here).alias("tail"))
    over = Window.orderBy("range")  # a row a range
    ends = ends.select("range", F.lag("tail").over(over).alias("tail"), F.lead("head").over(over).alias("head"))
    inside = Window.partitionBy("range").orderBy(*keys)
    out = cut.withColumns({"before": F.lag(here).over(inside), "after": F.lead(here).over(inside)}).join(ends, "range")
    out = out.withColumns({"before": F.coalesce("before", "tail"), "after": F.coalesce("after", "head")}).drop("range", "tail", "head")
    return out.withColumns({c: F.when(F.col(f"{c}.{by}") == F.col(by), F.col(c)) for c in ("before", "after")})


SPANS = "array<struct<place:long,first:int,end:int>>"
_SPANS = pa.list_(pa.struct([("place", pa.int64()), ("first", pa.int32()), ("end", pa.int32())]))
_LONGS, _BOOLS = pa.list_(pa.int64()), pa.list_(pa.bool_())


def _read(page: str | None):
    """Zones, lines and containers of a page, whether the tags name no article in it, and the keys of its lines outside an article and of all."""
    inside: list[tuple[int, int, int]] = []
    got = read_lines(page, inside) if page else []
    zones, lines = "".join(z for z, _ in got), [x for _, x in got]
    rest = [x for z, x in got if z != ARTICLE]
    key = _digest("\n".join([zones, *lines, str(inside)])) if got else None
    return zones, lines, inside, ARTICLE not in zones and PAGE in zones, _digest("\n".join(rest)) if rest else None, key


def _signs(batches):
    """What is ordered and aligned of each page: its keys, and the hashes of its lines."""
    for b in batches:
        zones, hashes, spans, opens, rests, keys = [], [], [], [], [], []
        for page in b.column("html").to_pylist():
            z, lines, inside, open_, rest, key = _read(page)
            zones.append(z), hashes.append([_digest(x) for x in lines]), spans.append(inside), opens.append(open_), rests.append(rest), keys.append(key)
        inside = pa.array([[dict(zip(("place", "first", "end"), x)) for x in s] for s in spans], _SPANS)
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("host", "path", "url")] + [pa.array(opens, pa.bool_()), pa.array(rests, pa.int64()), pa.array(keys, pa.int64()), pa.array(zones, pa.string()), pa.array(hashes, _LONGS), inside], names=["host", "path", "url", "open", "rest", "key", "zones", "hashes", "inside"])


def _texts(batches):
    """The lines that the tags let stand, with the class of the page and, without an article, their places among all its lines."""
    for b in batches:
        by, keys, n, texts, places = [], [], [], [], []
        for page, host in zip(b.column("html").to_pylist(), b.column("host").to_pylist()):
            zones, lines, _, open_, rest, key = _read(page)
            zone = PAGE if open_ else ARTICLE
            kept = [i for i, z in enumerate(zones) if z == zone]
            by.append(None if host is None or key is None else ("r" if open_ else "w") + host)
            keys.append(rest if open_ else key), n.append(len(lines)), texts.append("\n".join(lines[i] for i in kept)), places.append(kept if open_ else None)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(by, pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int32()), pa.array(texts, pa.string()), pa.array(places, pa.list_(pa.int32()))], names=["id", "url", "by", "key", "n", "text", "places"])


def _align(batches):
    """Each class with its partner: without an article which lines are shared, else how many outside it, and the containers shared whole (by article lines); votes on containers."""
    for b in batches:
        gone, n, whole, votes = [], [], [], []
        for path, zones, mine, inside, *near in zip(*(b.column(c).to_pylist() for c in ("path", "zones", "hashes", "inside", "before", "after"))):
            near = [(_common(path, x["path"]), -i, x["hashes"]) for i, x in enumerate(near) if x is not None]
            cut = shared(mine, max(near)[2]) if near else [False] * len(mine)
            if zones is None:
                gone.append(cut if any(cut) else None), n.append(sum(cut)), whole.append([]), votes.append([])
                continue
            story = [z == ARTICLE for z in zones]
            at, same = ([0, *accumulate(x)] for x in (story, (s and c for s, c in zip(story, cut))))
            all_ = [(same[x["end"]] - same[x["first"]] == at[x["end"]] - at[x["first"]], x) for x in inside]
            gone.append(None), n.append(sum(cut) - same[-1])
            whole.append([{"place": x["place"], "first": at[x["first"]], "end": at[x["end"]]} for yes, x in all_ if yes])
            say: dict[int, bool] = {}
            for yes, x in all_ if near and 2 * same[-1] < at[-1] else ():
                say[x["place"]] = yes and say.get(x["place"], True)
            votes.append([{"place": p, "yes": int(yes)} for p, yes in say.items()])
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("by", "key", "rows")] + [pa.array(gone, _BOOLS), pa.array(n, pa.int32()), pa.array(whole, _SPANS), pa.array(votes, pa.list_(pa.struct([("place", pa.int64()), ("yes", pa.int32())])))], names=["by", "key", "rows", "gone", "n_gone", "whole", "votes"])


def _cover(batches):
    """The article lines that spans cover."""
    for b in batches:
        gone = []
        for spans in b.column("spans").to_pylist():
            cut: list[bool] = []
            for x in sorted(spans, key=lambda x: x["first"]):
                if x["end"] > len(cut):
                    cut += [False] * (x["first"] - len(cut))
                    cut += [True] * (x["end"] - len(cut))
            gone.append(cut)
        yield pa.RecordBatch.from_arrays([b.column("by"), b.column("key"), pa.array(gone, _BOOLS)], names=["by", "key", "cover"])


def _decided(base: DataFrame, group: int) -> DataFrame:
    """(by, key, rows, gone, n_gone): for each class of pages, which of the lines that the tags let stand are deleted, and how many of all."""
    signs = materialize(base.select("host", "path", "url", "html").mapInArrow(_signs, f"host string, path string, url string, open boolean, rest long, key long, zones string, hashes array<long>, inside {SPANS}"), "signs")
    known = signs.where("host is not null and key is not null")
    units = known.select(F.concat(F.lit("w"), "host").alias("by"), "key", "path", "url", "zones", "hashes", "inside")
    count, opens = signs.agg(F.count("*"), F.max("open")).first()
    if opens:
        outside = F.transform(F.filter(F.arrays_zip("hashes", F.split("zones", "").alias("z")), lambda x: x["hashes"].isNotNull() & (x["z"] != ARTICLE)), lambda x: x["hashes"])
        rest = known.where("rest is not null").select(F.concat(F.lit("r"), "host").alias("by"), F.col("rest").alias("key"), "path", "url", F.lit(None).cast("string").alias("zones"), outside.alias("hashes"), F.lit(None).cast(SPANS).alias("inside"))
        units = units.unionByName(rest)
    first = F.min(F.struct("path", "url")).alias("first")
    classes = units.groupBy("by", "key").agg(first, F.first(F.struct("zones", "hashes", "inside")).alias("sign"), F.count("*").alias("rows"))
    classes = classes.select("by", "first.path", "first.url", "key", "sign.zones", "sign.hashes", "sign.inside", "rows")
    near = beside(classes, "by", ["path", "url", "key"], group, count, ("hashes",))
    met = materialize(near.mapInArrow(_align, f"by string, key long, rows long, gone array<boolean>, n_gone int, whole {SPANS}, votes array<struct<place:long,yes:int>>"), "aligned")

    votes = met.select("by", F.explode("votes").alias("v")).groupBy("by", F.col("v.place").alias("place")).agg(F.count("*").alias("n"), F.sum("v.yes").alias("yes"))
    furniture = materialize(votes.where((F.col("n") >= MANY) & (F.col("yes") >= MOST * F.col("n"))).select("by", "place"), "furniture")
    if furniture.isEmpty():
        return met.drop("whole", "votes")
    spans = met.select("by", "key", F.explode("whole").alias("x")).withColumn("place", F.col("x.place")).join(furniture, ["by", "place"], "left_semi")
    cover = spans.groupBy("by", "key").agg(F.collect_list("x").alias("spans")).mapInArrow(_cover, "by string, key long, cover array<boolean>")
    more = F.size(F.filter("cover", lambda x: x))
    both = met.drop("whole", "votes").join(cover, ["by", "key"], "left")
    return materialize(both.select("by", "key", "rows", F.coalesce("gone", "cover").alias("gone"), (F.col("n_gone") + F.when(F.col("cover").isNull(), 0).otherwise(more)).alias("n_gone")), "decided")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = GROUP) -> DataFrame:
    """Per page: id, url, text, n_chars, and the numbers of lines read and deleted as shared."""
    base = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    bare = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/]*)", 1))
    base = base.withColumns({"host": host, "path": F.regexp_replace(bare, r"^[^/]*", "")})
    decided = _decided(base, group)

    texts = base.select("id", "url", "host", "html").mapInArrow(_texts, f"id {base.schema['id'].dataType.simpleString()}, url string, by string, key long, n int, text string, places array<int>")
    # rows of no class and those of a class of many copies are dealt
    row = F.monotonically_increasing_id()
    hot = decided.where(F.col("rows") > HOT).select("by", "key", (F.col("rows") / HOT + 1).cast("int").alias("parts"))
    if hot.isEmpty():
        texts, decided = texts.withColumn("part", F.when(F.col("by").isNull(), row % 4096).otherwise(0)), decided.withColumn("part", F.lit(0).cast("long"))
    else:  # a row for every HOT pages at most
        texts = texts.withColumn("row", row).join(F.broadcast(hot), ["by", "key"], "left").withColumn("part", F.when(F.col("by").isNull(), F.col("row") % 4096).otherwise(F.coalesce(F.col("row") % F.col("parts"), F.lit(0))))
        parts = F.when(F.col("rows") > HOT, (F.col("rows") / HOT + 1).cast("int")).otherwise(1)
        decided = decided.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long"))))
    both = texts.join(decided.select("by", "key", "part", "gone", "n_gone"), ["by", "key", "part"], "left")
    left = F.filter(F.split("text", "\n"), lambda x, i: ~F.coalesce(F.get("gone", F.coalesce(F.get("places", i), i)), F.lit(False)))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = both.select("id", "url", text.alias("text"), "n", F.coalesce("n_gone", F.lit(0)).alias("gone"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), F.col("n").alias("n_lines"), F.col("gone").cast("int").alias("n_shared"))
