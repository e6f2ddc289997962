"""URL filters: host and path rules first, then a path-template tree for what no rule decides.

Every host has a tree of path segments. Segments that look variable (numbers, long hex) are typed wildcards. Literal
siblings are compared with the best labelled one of their shape (what their urls go on with): a sibling is merged into
its branch if two-proportion tests tell apart neither what the urls go on with nor, where both have labels, how many
are blocked. A sibling without labels takes part only if the labelled ones of its shape agree, so labelled purity
carries over to branches that no rule reaches. Labels are the rules' verdicts. The purity of a template is its share of
blocked labels, smoothed by that of the rest of its parent, which is smoothed by the rest of its own parent, up to 1/2
above the host. Templates whose purity reaches a threshold are rejected.

All branches of all levels are exploded, summed, compared and put together again in a fixed number of aggregations and
joins, whatever the depth; the urls or branches of a host are never gathered, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, discard

#: Verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Normal quantile of the comparisons, weight of the smoothing, purity of a rejected template.
Z, SMOOTH, REJECT = 1.96, 2.0, 0.8
#: Marks of wildcards; a path holds no question mark, so no literal segment looks like one.
NUMBER, HEX, MERGED = "?n", "?h", "?~"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path; both empty for null or a url without ://."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, shape, 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.coalesce(F.regexp_extract(url, shape, 2), F.lit(""))


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest fitting rule, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _token(segment: Column) -> Column:
    """The typed wildcard of a segment that looks variable (a number keeps its suffix), else the segment."""
    number = F.regexp_extract(segment, r"^\d+(\.\w+)?$", 1)
    return F.when(segment.rlike(r"^\d+(\.\w+)?$"), F.concat(F.lit(NUMBER), number)).when(segment.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), F.lit(HEX)).otherwise(segment)


def _nodes(host: Column, tokens: Column) -> Column:
    """Array of the ids of the host's node and of the node behind each token."""
    grown = lambda a, t: F.concat(a, F.array(F.md5(F.concat_ws("/", F.element_at(a, -1), t))))
    return F.aggregate(tokens, F.array(F.md5(host)), grown)


def _alike(k: str, n: str, k0: str, n0: str) -> Column:
    """Whether a two-proportion test, corrected for continuity, fails to tell k of n from k0 of n0."""
    a, b, c, d = map(F.col, (k, n, k0, n0))
    pooled, share = (a + c) / (b + d), 1 / b + 1 / d
    return F.abs(a / b - c / d) <= Z * F.sqrt(pooled * (1 - pooled) * share) + share / 2


_COUNTS = ("n", "b", "m", "ends", "typed")


def branches(urls: DataFrame) -> DataFrame:
    """host, tokens, n, b (blocked), m (labelled) -> parent, token of the literal segments that are merged, and into what."""
    steps = F.arrays_zip(F.slice(_nodes(F.col("host"), F.col("tokens")), F.lit(1), F.size("tokens")).alias("parent"), F.col("tokens").alias("token"), F.concat(F.slice("tokens", 2, F.greatest(F.size("tokens"), F.lit(1))), F.array(F.lit(""))).alias("next"))
    rows = urls.where(F.size("tokens") > 0).select("n", "b", "m", F.explode(steps).alias("s")).select("n", "b", "m", "s.*").where(~F.col("token").startswith("?"))
    sums = [F.sum(c).alias(c) for c in ("n", "b", "m")]
    cells = rows.groupBy("parent", "token").agg(*sums, F.sum(F.when(F.col("next") == "", F.col("n")).otherwise(0)).alias("ends"), F.sum(F.when(F.col("next").startswith("?"), F.col("n")).otherwise(0)).alias("typed"))
    literal = F.col("n") - F.col("ends") - F.col("typed")
    shape = F.when((F.col("ends") >= F.col("typed")) & (F.col("ends") >= literal), "ends").when(F.col("typed") >= literal, "typed").otherwise("literal")
    cells = cut(cells.withColumn("shape", shape))
    first = F.min(F.struct((-F.col("m")).alias("x"), (-F.col("n")).alias("y"), "token", *_COUNTS)).alias("hub")
    hubs = cells.groupBy("parent", "shape").agg(first, F.count("*").alias("k")).where("k > 1")
    hubs = cut(hubs.select("parent", "shape", F.col("hub.token").alias("hub"), *[F.col(f"hub.{c}").alias(f"{c}0") for c in _COUNTS]))
    same = _alike("ends", "n", "ends0", "n0") & _alike("typed", "n", "typed0", "n0")
    agree = F.when((F.col("m") > 0) & (F.col("m0") > 0), _alike("b", "m", "b0", "m0")).otherwise(True)
    tested = cut(cells.join(hubs, ["parent", "shape"]).select("parent", "shape", "token", "m", "hub", (same & agree).alias("alike"), (same & ~agree).alias("against")))
    sides = tested.groupBy("parent", "shape").agg(F.max("against").alias("against"))
    merged = tested.drop("against").join(sides, ["parent", "shape"]).where(F.col("alike") & ((F.col("m") > 0) | ~F.col("against")))
    several = merged.groupBy("parent", "shape").agg(F.count("*").alias("k")).where("k > 1").select("parent", "shape")
    out = cut(merged.join(several, ["parent", "shape"], "left_semi").select("parent", "token", F.concat(F.lit(MERGED), "shape").alias("into")))
    discard(cells, hubs, tested)
    return out


def templates(urls: DataFrame) -> DataFrame:
    """host, path, blocked, allowed (labels by rules) and n of distinct urls -> host, path, template, labelled, purity."""
    tokens = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _token)
    rows = cut(urls.select("host", "path", tokens.alias("tokens"), "n", F.col("blocked").alias("b"), (F.col("blocked") + F.col("allowed")).alias("m")))
    merges = branches(rows)
    key = F.md5(F.concat_ws("/", F.md5("host"), "path")).alias("key")
    steps = F.arrays_zip(F.slice(_nodes(F.col("host"), F.col("tokens")), F.lit(1), F.size("tokens")).alias("parent"), F.col("tokens").alias("token"))
    spread = rows.where(F.size("tokens") > 0).select(key, F.posexplode(steps).alias("at", "s")).select("key", "at", "s.*")
    changed = spread.join(merges, ["parent", "token"]).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("at", "into"))).alias("into"))  # of one url
    placed = rows.withColumn("key", key).join(changed, "key", "left")
    shown = F.transform("tokens", lambda t, i: F.coalesce(F.col("into")[i], t))
    placed = cut(placed.select("host", "path", "b", "m", F.when(F.col("into").isNull(), F.col("tokens")).otherwise(shown).alias("tokens")))
    sums = [F.sum("b").alias("b"), F.sum("m").alias("m")]
    leaves = cut(placed.groupBy("host", "tokens").agg(*sums))
    # A leaf's own id ends with an empty token, so that urls which go on do not count for it.
    nodes = _nodes(F.col("host"), F.concat("tokens", F.array(F.lit(""))))
    each = leaves.select("host", "tokens", "b", "m", F.posexplode(nodes).alias("at", "node"))
    totals = each.groupBy("node").agg(*[s.alias(f"{c}1") for s, c in zip(sums, "bm")])
    lines = each.join(totals, "node").groupBy("host", "tokens").agg(F.sort_array(F.collect_list(F.struct("at", "b1", "m1"))).alias("line"))  # as long as a url is deep

    def rest(acc: Column, x: Column) -> Column:
        q = (acc["b"] - x["b1"] + SMOOTH * acc["q"]) / (acc["m"] - x["m1"] + SMOOTH)
        return F.struct(x["b1"].alias("b"), x["m1"].alias("m"), q.alias("q"))

    top = F.element_at("line", 1)
    start = F.struct(top["b1"].alias("b"), top["m1"].alias("m"), F.lit(0.5).alias("q"))
    end = F.aggregate(F.slice(F.col("line"), F.lit(2), F.size("line")), start, rest, lambda a: F.struct(a["m"].alias("labelled"), ((a["b"] + SMOOTH * a["q"]) / (a["m"] + SMOOTH)).alias("purity")))
    judged = lines.select("host", "tokens", end.alias("e")).select("host", "tokens", "e.*")
    out = cut(placed.join(judged, ["host", "tokens"]).select("host", "path", F.concat_ws("/", "host", F.array_join("tokens", "/")).alias("template"), "labelled", "purity"))
    discard(rows, merges, placed, leaves)
    return out


def judge(pages: DataFrame, *, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, reject: float = REJECT) -> DataFrame:
    """Key, host, path, rule, verdict, template and purity of every row.

    Null urls and urls without :// have an empty host and path, no rule, and the verdict of the template of an empty
    host (purity 1/2: allow). A rule always beats the tree; among rules of one length the later by name wins. Repeated
    rows count as often as they occur. Equal branches are ordered by name. Null keys stay null, empty tables give empty
    results, other columns are not carried. Urls of any length and depth are used whole.
    """
    host, path = parts(F.col(url))
    parsed = cut(pages.select(F.col(key), host.alias("host"), path.alias("path")).withColumn("r", _rule(F.col("host"), F.col("path"), rules)))
    label = lambda v: F.sum(F.when(F.col("r.verdict") == v, 1).otherwise(0)).alias(v)
    urls = parsed.groupBy("host", "path").agg(F.count("*").alias("n"), label("block"), label("allow")).withColumnsRenamed({"block": "blocked", "allow": "allowed"})
    joined = parsed.join(templates(urls), ["host", "path"])
    learned = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return joined.select(key, "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", learned).alias("verdict"), "template", "purity")
