"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern, leftmost and non-overlapping for each kind:

* ``assign``: a password-like name, a sign and a value of 6 characters or more,
* ``access``: an access key id of 20 characters or more,
* ``hex``: a run of 24 or more lower-case hexadecimal digits,
* ``bare``: added by the method: an unassigned token of 32 or more
  characters with capitals, small letters and digits, outside all base spans,
  that is live-looking.

Each candidate's value is hashed and counted over the whole corpus by distinct
repositories and owners (``repo_col``, ``owner_col``: name real columns where
the table has them). A value that appears under more than ``max_owners`` owners
is a widely copied example; any other is owner-specific and live-looking,
however many repositories or documents of its owners hold it. With
``max_repos`` a value in more repositories than that is an example too. Counts
are taken in two map-side-combined steps, so a value in a third of all rows
meets no task whole.

Positions are code points: a text split by a pattern gives the gaps, the
matches give the lengths, and their running sum gives every start. Null and
empty texts have no spans. A null owner is an owner of its own. Ties of start
are in the order of kinds above. Repeated rows are all reported. Very long
texts are scanned whole: a text's matches are summed up in two levels, and
overlaps are found in start order, so the cost follows the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# The base patterns, letters of the names in either case.
NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
HEAD = f"({NAMES})[\"']?\\x20*[:=]\\x20*[\"']?"
ASSIGN = HEAD + "([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
BARE = "[A-Za-z0-9+/_=-]{32,}"
BASE = ("assign", "access", "hex")
MAX_OWNERS = 2
#: Matches of a text that are summed up at once; chunks are then moved to their place.
CHUNK = 256
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value made once a row, not once an element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(sizes: Column) -> Column:
    """Sums of what stands before each element."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(sizes, zero, step, lambda acc: acc["out"])


def _starts(sizes: Column) -> Column:
    """_running() of an array of any length, chunk by chunk: appending copies a chunk, never the whole."""
    zero = lambda n: F.aggregate(n, F.lit(0), lambda a, x: a + x)
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda k: F.slice(x, k * CHUNK + 1, CHUNK))
    moved = lambda chunks: F.flatten(F.zip_with(chunks, _running(F.transform(chunks, zero)), lambda c, at: F.transform(_running(c), lambda s: s + at)))
    return _let(sizes, lambda x: F.when(F.size(x) > 0, _let(cut(x), moved)).otherwise(F.array().cast("array<int>")))


def _spans(text: Column, pattern: str, kind: int, least: int | None = None) -> Column:
    """Array of (start, kind, end, value) of a pattern's matches; with ``least``, values of the second group that long."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0 if least is None else 2))

    # made once a row; the last gap has no match after it
    def placed(x: Column) -> Column:
        starts = _starts(F.transform(x, lambda m: m["0"] + F.coalesce(m["1"], F.lit(0))))
        span = lambda m, at: F.struct((at + m["0"]).alias("start"), F.lit(kind).alias("kind"), (at + m["0"] + m["1"]).alias("end"), m["2"].alias("value"))
        return F.zip_with(x, starts, span)

    walked = F.filter(_let(F.arrays_zip(gaps, found, values), placed), lambda s: s["value"].isNotNull() & (F.length(s["value"]) >= (least or 0)))
    return F.when(text.rlike(pattern), walked.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def candidates(text: Column) -> tuple[Column, Column]:
    """Base spans by start and kind, and bare tokens."""
    base = F.array_sort(F.concat(_spans(text, ASSIGN, 0, 6), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    bare = F.filter(_spans(text, BARE, 3), lambda s: s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]") & s["value"].rlike("[0-9]"))
    return base, bare


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in (*BASE, "bare")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int | None = None, text_key: bool = False) -> DataFrame:
    """Per document: id, counts, base digest, spans, and ``found``: every span with its value, owners, repositories and verdict.

    With ``text_key`` also ``text_md5``, NULL where a text has no candidate.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    raw = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{repo_col}`").cast("string").alias("repo"), F.col(f"`{owner_col}`").cast("string").alias("owner"), text.alias("text"))
    hint = raw.withColumn("any", F.col("text").rlike(f"(?:{NAMES})|AKIA|{HEX}|{BARE}"))
    base, bare = candidates(F.when(F.col("any"), F.col("text")).otherwise(F.lit("")))
    key = [F.when(F.col("any"), F.md5(F.col("text").cast("binary"))).alias("key")] if text_key else []
    carried = ["row", "id", "base", *(["key"] if text_key else [])]
    slim = materialize(hint.select("id", "repo", "owner", base.alias("base"), bare.alias("bare"), *key).withColumn("row", F.monotonically_increasing_id()), "secrets")

    # bare tokens that meet no base span: in start order, neither a base span that began before and has not ended,
    # nor one that begins before the token's end
    bare = slim.where(F.size("bare") > 0)
    both = bare.select("row", "repo", "owner", F.explode("bare").alias("s")).unionByName(bare.select("row", "repo", "owner", F.explode("base").alias("s")))
    ahead, behind = Window.partitionBy("row").orderBy(F.col("s.start")), Window.partitionBy("row").orderBy(F.col("s.start").desc())
    of_base = lambda c: F.when(F.col("s.kind") < 3, F.col(c))
    open_end = F.max(of_base("s.end")).over(ahead.rangeBetween(Window.unboundedPreceding, 0))
    next_start = F.min(of_base("s.start")).over(behind.rangeBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"open": open_end, "next": next_start}).where("s.kind = 3")
    clear = both.where((F.col("open").isNull() | (F.col("open") <= F.col("s.start"))) & (F.col("next").isNull() | (F.col("next") >= F.col("s.end")))).drop("open", "next")

    each = slim.where(F.size("base") > 0).select("row", "repo", "owner", F.explode("base").alias("s")).unionByName(clear)
    each = each.withColumn("h", F.sha2("s.value", 256))
    owners = each.groupBy("h", "owner").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("owners"))
    repos = each.groupBy("h", "repo").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("repos"))
    freq = owners.join(repos, "h")
    judged = each.select("row", "h", "s").join(freq, "h").withColumn("live", (F.col("owners") <= max_owners) & (F.lit(True) if max_repos is None else F.col("repos") <= max_repos))
    judged = judged.where("s.kind < 3 or live")
    found = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("s.value").alias("value"), "owners", "repos", "live"))).alias("found"))
    empty = F.array().cast(found.schema["found"].dataType)
    any_span = (F.size("base") > 0) | (F.size("bare") > 0)
    out = slim.where(any_span).select(*carried).join(found, "row", "left").withColumn("found", F.coalesce("found", empty))
    out = out.unionByName(slim.where(~any_span).select(*carried, empty.alias("found")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_copied"), "found",
        *([F.col("key").alias("text_md5")] if text_key else []),
    )


def _masked(text: Column, cuts: Column, mask: str) -> Column:
    """``text`` with each of ``cuts`` (start, end; in order, apart) replaced, CHUNK at a time: a cut is sought in its chunk's part of the text."""
    end_before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(cuts, k * CHUNK - 1)["end"])

    def part(k: Column) -> Column:
        def body(x: Column) -> Column:  # chunk, its base and its text
            since = lambda i: F.when(i == 0, x["base"]).otherwise(F.get(x["c"], i - 1)["end"])
            return F.array_join(F.transform(x["c"], lambda s, i: F.concat(F.substring(x["t"], since(i) - x["base"] + 1, s["start"] - since(i)), F.lit(mask))), "")

        chunk = F.slice(cuts, k * CHUNK + 1, CHUNK)
        return _let(_let(chunk, lambda c: F.struct(c.alias("c"), end_before(k).alias("base"), F.substring(text, end_before(k) + 1, F.element_at(c, -1)["end"] - end_before(k)).alias("t"))), body)

    chunks = F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / CHUNK).cast("int"))
    return F.concat(F.array_join(F.transform(chunks, part), ""), F.substring(text, F.element_at(cuts, -1)["end"] + 1, F.length(text)))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", mask: str = "[SECRET]", max_owners: int = MAX_OWNERS, max_repos: int | None = None) -> DataFrame:
    """``docs`` with every live-looking span of a text replaced by ``mask``, those that overlap by one; widely copied examples stay.

    A text's spans and their verdicts follow from the text and the corpus alone, so they are looked up by text: rows
    of one id, or without one, never meet each other's spans, and equal texts share theirs.
    """
    found = scan(docs, id_col, text_col, repo_col, owner_col, max_owners, max_repos, text_key=True).where("n_live > 0")
    spans = found.select(F.col("text_md5").alias("__key"), F.inline(F.filter("found", lambda s: s["live"]))).select("__key", "start", "end").distinct()
    before = Window.partitionBy("__key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("__key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0)), 1).otherwise(0)
    cuts = spans.withColumn("new", new).withColumn("cut", F.sum("new").over(upto)).groupBy("__key", "cut").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = cuts.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    text = F.col(f"`{text_col}`")
    joined = docs.withColumn("__key", F.md5(text.cast("binary"))).join(cuts, "__key", "left")
    return joined.withColumn(text_col, F.when(F.col("__cuts").isNull(), text).otherwise(_masked(text, F.col("__cuts"), mask))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB's form of the same scan: matches by their gaps, counted values, verdicts.
ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, source FROM documents),
kinds(kind, name, pat, grp, least) AS (VALUES
  (0, 'assign', '{ASSIGN.replace("'", "''")}', 2, 6), (1, 'access', '{ACCESS}', 0, 0), (2, 'hex', '{HEX}', 0, 0), (3, 'bare', '{BARE}', 0, 0)),
hit AS (SELECT d.*, kinds.* FROM d, kinds WHERE regexp_matches(d.t, kinds.pat)),
m AS (SELECT rid, doc_id, source, kind, name, least, t,
  CASE kind WHEN 0 THEN regexp_extract_all(t, '{ASSIGN.replace("'", "''")}', 0) WHEN 1 THEN regexp_extract_all(t, '{ACCESS}', 0) WHEN 2 THEN regexp_extract_all(t, '{HEX}', 0) ELSE regexp_extract_all(t, '{BARE}', 0) END AS found,
  CASE kind WHEN 0 THEN regexp_extract_all(t, '{ASSIGN.replace("'", "''")}', 2) WHEN 1 THEN regexp_extract_all(t, '{ACCESS}', 0) WHEN 2 THEN regexp_extract_all(t, '{HEX}', 0) ELSE regexp_extract_all(t, '{BARE}', 0) END AS vals,
  CASE kind WHEN 0 THEN regexp_split_to_array(t, '{ASSIGN.replace("'", "''")}') WHEN 1 THEN regexp_split_to_array(t, '{ACCESS}') WHEN 2 THEN regexp_split_to_array(t, '{HEX}') ELSE regexp_split_to_array(t, '{BARE}') END AS gaps FROM hit),
e AS (SELECT rid, doc_id, source, kind, name, least, vals[i] AS val, len(found[i]) AS n,
  list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: len(x))), 0) AS s
  FROM m, unnest(range(1, len(found) + 1)) AS u(i)),
c AS (SELECT *, s + n AS e FROM e WHERE (kind <> 0 OR len(val) >= 6) AND (kind <> 3 OR (regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[0-9]')))),
a AS (SELECT * FROM c WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM c b WHERE b.kind < 3 AND b.rid = c.rid AND b.s < c.e AND c.s < b.e)),
f AS (SELECT val, count(DISTINCT coalesce(source, chr(0))) AS owners FROM a GROUP BY val),
j AS (SELECT a.*, f.owners <= {MAX_OWNERS} AS live FROM a JOIN f USING (val)),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
  coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3), '') AS base,
  coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3 OR live), '') AS spans,
  count(*) FILTER (live) AS nl, count(*) FILTER (kind < 3 AND NOT live) AS nc FROM j GROUP BY rid)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(nl, 0)::BIGINT AS n_live, coalesce(nc, 0)::BIGINT AS n_copied
FROM d LEFT JOIN g ON d.rid = g.rid
"""
